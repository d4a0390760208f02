"""Adapter from the generated star-schema test tables to the suite's inputs.

The synthetic tables (``orders``, ``customer``, ``nation``, ``events``)
are reshaped into ``user_info`` / ``events`` / ``geography`` with plain
column arithmetic, so every derived table grows with the inputs.  The
same rules are written independently in DuckDB SQL by the oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params
from .tables import Tables, conform

AS_OF = dt.date(2024, 2, 1)

# thresholds scaled to the synthetic data (the default thresholds would leave
# several reports empty or single-class)
TEST_PARAMS = Params(
    as_of=AS_OF,
    min_country_users=50,
    gaming_min_events=3,
    gaming_report_min_events=3,
    engagement_classes=(60, 45, 30, 15),
    clv_classes=(4000.0, 2000.0, 1000.0, 0.0),
    cluster_high_revenue=2000.0,
    cluster_medium_revenue=1000.0,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _platform_from_priority(priority) -> F.Column:
    return (F.when(priority == "1-URGENT", "web")
            .when(priority == "3-MEDIUM", "ios")
            .when(priority == "4-NOT SPECIFIED", F.lit(None).cast("string"))
            .otherwise("android"))


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    day_no = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    created = F.date_add(F.lit("2023-10-01").cast("date"), (day_no % 120).cast("int"))
    login_offset = F.when(F.col("o_custkey") % 10 == 0, F.col("o_orderkey") % 5).otherwise(F.col("o_orderkey") % 60)
    df = (
        o.join(c, o.o_custkey == c.c_custkey, "inner")
        .select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderkey") % 101 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("user_id"),
            created.alias("created_date"),
            F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date"))
             .otherwise(F.date_add(created, login_offset.cast("int"))).alias("last_login"),
            _platform_from_priority(F.col("o_orderpriority")).alias("platform"),
            F.element_at(F.array(F.lit("android"), F.lit("ios"), F.lit("windows"), F.lit(None).cast("string")),
                         (F.col("o_custkey") % 4 + 1).cast("int")).alias("os"),
            F.col("c_nationkey").cast("string").alias("mp_country_code"),
            F.col("c_mktsegment").alias("feature"),
        )
    )
    return conform(df, "user_info")


def _platform_from_type(event_type) -> F.Column:
    return (F.when(event_type.isin("view", "signup"), "web")
            .when(event_type.isin("click", "error"), "android")
            .when(event_type == "purchase", "ios"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform and JSON text of every event."""
    return _read(spark, sf_dir, "events").select(_platform_from_type(F.col("event_type")).alias("platform"), "props")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    # each user's events move back by up to 24 days, so that recency varies; every row stays
    moved = F.col("ts") - F.make_dt_interval(days=F.coalesce((F.col("user_id") * 7) % 25, F.lit(0)).cast("int"))
    platform = _platform_from_type(F.col("event_type"))
    df = e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
        moved.alias("datetime"),
        F.to_date(moved).alias("date"),
        platform.alias("platform"),
        (F.col("event_id") % 10).cast("double").alias("volume"),
        F.col("value").cast("decimal(18,2)").alias("fee"),
    )
    return conform(df, "events")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as events: a many-month series for monthly/weekly trends."""
    o = _read(spark, sf_dir, "orders")
    df = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("datetime"),
        F.to_date("o_orderdate").alias("date"),
        _platform_from_priority(F.col("o_orderpriority")).alias("platform"),
        (F.col("o_orderkey") % 10).cast("double").alias("volume"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("fee"),
    )
    return conform(df, "events")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    df = n.select(
        F.col("n_nationkey").cast("string").alias("code"),
        F.col("n_name").alias("country"),
        (F.col("n_nationkey") * 5.0 - 60).cast("double").alias("latitude"),
        (F.col("n_nationkey") * 15.0 - 180).cast("double").alias("longitude"),
    )
    return conform(df, "geography")


def tables(spark: SparkSession, sf_dir: str, event_view: str = "events") -> Tables:
    ev = events(spark, sf_dir) if event_view == "events" else order_events(spark, sf_dir)
    return Tables(user_info(spark, sf_dir), ev, geography(spark, sf_dir), properties=event_properties(spark, sf_dir))


def write_tables(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Materialise the adapted tables as Parquet (bench inputs)."""
    out = out_dir.rstrip("/")
    user_info(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/user_info")
    events(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/events")
    order_events(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/order_events")
    geography(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/geography")
