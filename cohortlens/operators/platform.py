"""Platform usage reports over the events table.

Every report is one hash aggregation (partial aggregation before the
shuffle, so a hot date/platform/user is combined map-side); windows only
run over the handful of aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dbl, div, pct, rnd
from ..functions.labels import PLATFORMS


def platform_use(events: DataFrame) -> DataFrame:
    """Events per date pivoted to web/android/ios; dates with only other
    platforms still appear, with zeros.  (CTAS ``platform_use``)"""
    counts = [F.count(F.when(F.col("platform") == p, F.lit(1))).alias(p) for p in PLATFORMS]
    return events.groupBy("date").agg(*counts)


def volume_use(events: DataFrame) -> DataFrame:
    """Daily volume.  (CTAS ``volume_use``)"""
    return events.groupBy("date").agg(F.sum("volume").alias("volume")).select("volume", "date")


def platform_comparison(events: DataFrame) -> DataFrame:
    """Per platform, known users only: users, sessions, totals and averages."""
    agg = (
        events.filter(F.col("user_id").isNotNull())
        .groupBy("platform")
        .agg(
            F.countDistinct("user_id").alias("unique_users"),
            F.count(F.lit(1)).alias("total_sessions"),
            F.sum("volume").alias("total_volume"),
            F.sum("fee").alias("_fee"),
            F.count("volume").alias("_nv"),
            F.count("fee").alias("_nf"),
        )
    )
    return agg.select(
        "platform", "unique_users", "total_sessions", "total_volume",
        dbl("_fee").alias("total_revenue"),
        div("total_volume", "_nv").alias("avg_volume_per_session"),
        div("_fee", "_nf").alias("avg_fee_per_session"),
    ).orderBy(F.col("total_revenue").desc_nulls_last())


def daily_platform_trends(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("date", "platform")
        .agg(
            F.countDistinct("user_id").alias("daily_active_users"),
            F.sum("volume").alias("daily_volume"),
            dbl(F.sum("fee")).alias("daily_revenue"),
        )
        .orderBy("date", "platform")
    )


def platform_performance(events: DataFrame) -> DataFrame:
    stats = events.groupBy("platform").agg(
        F.countDistinct("user_id").alias("users"),
        F.sum("volume").alias("_v"), F.count("volume").alias("_nv"),
        F.sum("fee").alias("_f"), F.count("fee").alias("_nf"),
        F.count(F.lit(1)).alias("sessions"),
    )
    everyone = Window.partitionBy()  # over the few platform rows only
    return stats.select(
        "platform", "users", "sessions",
        rnd(div("sessions", "users"), 2).alias("sessions_per_user"),
        rnd(div("_v", "_nv"), 2).alias("avg_volume"),
        rnd(div("_f", "_nf"), 2).alias("avg_fee"),
        rnd(pct("users", F.sum("users").over(everyone)), 2).alias("user_percentage"),
    ).orderBy(F.col("users").desc())
