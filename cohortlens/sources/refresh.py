"""Refresh a stored daily table from a changed source: only days whose source
rows changed are computed and written again.

``path/data`` holds the table, partitioned by day; ``path/digests`` holds, per
day, the digest of the source rows it was built from (``plans.digests``).  A
refresh reads the source once for its digests and reads the changed days again
to build them.  It first marks the changed days as unfinished, then swaps their
partitions by dynamic overwrite, then stores their digests: a run that is lost
half-way leaves days marked that the next run builds again.

The list of changed days passes through the driver: one row a day, so its
length is bounded by the calendar and not by the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.digests import differing, digests

UNFINISHED = -1


def _digest_schema(day: str) -> T.StructType:
    total = T.DecimalType(38, 0)
    return T.StructType([T.StructField("n_rows", T.LongType()), T.StructField("sum_1", total),
                         T.StructField("sum_2", total), T.StructField(day, T.DateType())])


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def _swap(df: DataFrame, path: str, day: str) -> None:
    """Replace the partitions of the days in ``df`` and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def _drop(spark: SparkSession, path: str, day: str, days: list[dt.date | None]) -> None:
    """Delete the partitions of ``days``."""
    for d in days:
        fs, folder = _folder(spark, f"{path}/{day}={'__HIVE_DEFAULT_PARTITION__' if d is None else d.isoformat()}")
        fs.delete(folder, True)


def _of_days(df: DataFrame, day: str, days: list[dt.date | None]) -> DataFrame:
    known = [d for d in days if d is not None]
    keep = F.col(day).isin(known) if known else F.lit(False)
    return df.filter(keep | F.col(day).isNull() if None in days else keep)


def refresh_by_day(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str,
                   day: str = "date") -> list[dt.date | None]:
    """Bring the table at ``path`` up to date with ``source``; returns the days it built.

    ``build`` must make the rows of a day from that day's source rows alone (``day`` is a
    date column of both; a null day is a day of its own), as the daily reports and the
    session recalculation do.  A day that left the source, or for which ``build`` gives no
    row, leaves the table.  ``source`` must not change during the run: give a snapshot,
    such as a frame over listed files."""
    spark = source.sparkSession
    data, seen = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/digests"
    schema = _digest_schema(day)
    first = not _exists(spark, seen)
    stored = spark.createDataFrame([], schema) if first else spark.read.schema(schema).parquet(seen)
    now = digests(source, {day: F.col(day)})
    changed = differing(stored, now, [day]).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).collect()
    if not changed:
        return []
    days = [r[day] for r in changed]
    marked = [(UNFINISHED, None, None, d) for d in days]
    _swap(spark.createDataFrame(marked, schema).coalesce(1), seen, day)
    built = build(source if first else _of_days(source, day, days))
    written = Observation()
    _swap(built.hint("rebalance", F.col(day)).observe(written, F.collect_set(day).alias("days"),
                                                      F.count_if(F.col(day).isNull()).alias("dayless")), data, day)
    filled = {*written.get["days"], *([None] if written.get["dayless"] else [])}
    _drop(spark, data, day, [d for d in days if d not in filled])
    there = [tuple(r) for r in changed if r["n_rows"]]
    _swap(spark.createDataFrame(there, schema).coalesce(1), seen, day)
    _drop(spark, seen, day, [r[day] for r in changed if not r["n_rows"]])
    return sorted(days, key=lambda d: (d is not None, d or dt.date.min))


def refreshed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``refresh_by_day`` keeps at ``path``, of the columns and types of ``schema``."""
    data = f"{path.rstrip('/')}/data"
    if not _exists(spark, data):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(data).select(*schema.fieldNames())
