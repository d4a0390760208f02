"""Account retention reports (user_info only).

The interval report is written in the suite as eight scans of the
accounts table joined back together on ``created_date``; here it is a
single aggregation with one conditional count per interval (one scan,
one shuffle).  A missing interval row in the original equals a zero
count here, and both give ``day0 / day0 = 100%``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import date_lit, div, pct, percent_text, rnd
from ..params import DEFAULT, Params


def retention_intervals(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    life = F.coalesce(F.datediff("last_login", "created_date"),
                      F.datediff(date_lit(params.as_of), F.col("created_date")))
    steps = range(1, params.retention_steps + 1)
    counts = [F.count(F.when(life <= params.retention_step_days * k, F.col("id"))).alias(f"_d{k}") for k in steps]
    agg = user_info.groupBy("created_date").agg(F.count("id").alias("_d0"), *counts)
    shares = [
        percent_text(rnd(div(F.col("_d0") - F.col(f"_d{k}"), "_d0") * F.lit(100.0), 2)).alias(f"day{k}_retention")
        for k in steps
    ]
    return agg.select("created_date", div("_d0", "_d0").alias("day0_retention"), *shares).orderBy("created_date")


def cohort_retention_monthly(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    w = params.cohort_windows
    kept = [F.count(F.when(F.col("last_login") >= F.date_add("created_date", d), F.lit(1))).alias(f"_r{d}") for d in w]
    agg = (user_info.filter(F.col("created_date").isNotNull())
           .groupBy(F.year("created_date").cast("long").alias("year"),
                    F.month("created_date").cast("long").alias("month"))
           .agg(F.count(F.lit(1)).alias("cohort_size"), *kept))
    return agg.select(
        "year", "month", "cohort_size",
        *[rnd(pct(f"_r{d}", "cohort_size"), 2).alias(f"retention_{d}d_pct") for d in w],
    ).orderBy("year", "month")


def platform_retention(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    w = params.cohort_windows
    used = F.datediff("last_login", "created_date")
    agg = (user_info.filter(F.col("platform").isNotNull() & F.col("last_login").isNotNull()
                            & F.col("created_date").isNotNull())
           .groupBy("platform")
           .agg(F.count(F.lit(1)).alias("total_users"),
                *[F.count(F.when(used >= d, F.lit(1))).alias(f"retained_{d}d") for d in w]))
    return agg.select(
        "platform", "total_users", *[f"retained_{d}d" for d in w],
        *[rnd(pct(f"retained_{d}d", "total_users"), 2).alias(f"retention_{d}d_pct") for d in w],
    ).orderBy(F.col(f"retention_{w[-1]}d_pct").desc_nulls_last())
