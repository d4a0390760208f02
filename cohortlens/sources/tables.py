"""Input tables: schemas, readers and light validation.

The suite works on three tables:

* ``user_info`` — one row per *account*; ``user_id`` is nullable and
  not unique (one person may own many accounts).
* ``events`` — one row per usage event.
* ``geography`` — country dimension keyed by ``code``.

Readers only declare what to read; column pruning and filter pushdown
into the Parquet scan are left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER_INFO_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("created_date", T.DateType(), True),
    T.StructField("last_login", T.DateType(), True),
    T.StructField("platform", T.StringType(), True),
    T.StructField("os", T.StringType(), True),
    T.StructField("mp_country_code", T.StringType(), True),
    T.StructField("feature", T.StringType(), True),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("datetime", T.TimestampNTZType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("platform", T.StringType(), True),
    T.StructField("volume", T.DoubleType(), True),
    T.StructField("fee", T.DecimalType(18, 2), True),
])

GEOGRAPHY_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("country", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
])

SCHEMAS = {"user_info": USER_INFO_SCHEMA, "events": EVENTS_SCHEMA, "geography": GEOGRAPHY_SCHEMA}


@dataclass(frozen=True)
class Tables:
    """The three inputs of the suite.  ``geography_updated``: the dimension that
    the country reports on trial abuse read instead of ``geography``, if given.
    ``properties``: ``platform`` and JSON text ``props`` of events, for ``event_properties``."""
    user_info: DataFrame
    events: DataFrame
    geography: DataFrame
    geography_updated: DataFrame | None = None
    properties: DataFrame | None = None

    @property
    def abuse_geography(self) -> DataFrame:
        return self.geography if self.geography_updated is None else self.geography_updated


# input types that carry a wanted type without a guess
_TEXT = (T.StringType,)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
_FITS = {T.LongType: _WHOLE, T.DoubleType: _NUMBER, T.DecimalType: _NUMBER, T.StringType: (*_TEXT, *_WHOLE),
         T.DateType: (T.DateType,), T.TimestampNTZType: (T.TimestampNTZType, T.TimestampType, T.DateType)}


def check_columns(df: DataFrame, name: str) -> DataFrame:
    """Fail early when a required column is missing or has an incompatible type
    (an untyped null column fits any)."""
    want = SCHEMAS[name]
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in want.fields if f.name not in have]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    wrong = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want.fields
             if not isinstance(have[f.name], (T.NullType, *_FITS[type(f.dataType)]))]
    if wrong:
        raise ValueError(f"{name}: {', '.join(wrong)}")
    return df


def _typed(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """``column`` as the wanted type.  A TIMESTAMP (an instant) becomes its UTC
    wall clock, whatever the session's time zone."""
    if isinstance(have, T.TimestampType) and isinstance(want, T.TimestampNTZType):
        micros = F.unix_micros(column)
        return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))
    return column.cast(want)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select the declared columns in declared order, cast to declared types."""
    check_columns(df, name)
    return df.select(*[_typed(df[f.name], df.schema[f.name].dataType, f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def read_parquet_tables(spark: SparkSession, path: str) -> Tables:
    """Read ``user_info``, ``events`` and ``geography`` Parquet under ``path``."""
    def rd(name):
        return conform(spark.read.parquet(f"{path.rstrip('/')}/{name}"), name)
    return Tables(rd("user_info"), rd("events"), rd("geography"))


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None) -> Tables:
    """Read the three tables from ``path/<name>`` in any Spark source format
    (``csv``, ``json``, ``orc``, ``parquet``...).  The declared schemas are
    given to the reader, so text formats are parsed without a schema
    inference pass over the data."""
    def rd(name):
        reader = spark.read.format(fmt).schema(SCHEMAS[name]).options(**(options or {}))
        return conform(reader.load(f"{path.rstrip('/')}/{name}"), name)
    return Tables(rd("user_info"), rd("events"), rd("geography"))


def read_catalog_tables(spark: SparkSession, database: str | None = None) -> Tables:
    """Read the three tables from the session catalog (``saveAsTable`` output)."""
    prefix = f"{database}." if database else ""
    return Tables(*(conform(spark.table(prefix + n), n) for n in ("user_info", "events", "geography")))
