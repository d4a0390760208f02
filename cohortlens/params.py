"""Run parameters shared by every operator.

Defaults are the values the analytics suite was written with; callers
override them (``Params(as_of=..., ...)`` or ``params.with_(...)``) when
their data has a different date range or size.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # reporting date that stands in for "today"
    as_of: dt.date = dt.date(2023, 4, 1)
    # second fallback date of the first abuse query; only reached when
    # created_date is NULL, where it yields NULL as well
    abuse_fallback_date: dt.date = dt.date(2023, 3, 1)

    # retention
    retention_step_days: int = 7
    retention_steps: int = 7
    cohort_windows: tuple[int, int, int] = (7, 14, 30)

    # trial abuse
    trial_days: int = 3
    repeat_threshold: int = 5          # accounts per (user, country, os) must exceed this
    min_country_users: int = 100       # trial_suspension_by_country HAVING
    anomaly_extreme: int = 10
    anomaly_high: int = 5
    anomaly_medium: int = 2
    anomaly_medium_max_days: float = 7.0

    # geography
    top_countries_k: int = 15
    os_top_countries_k: int = 10
    seasonal_top_countries_k: int = 5
    min_revenue_country_users: int = 10
    min_platform_share_users: int = 5
    min_engagement_country_users: int = 20
    cluster_min_users: int = 10
    cluster_high_revenue: float = 10.0
    cluster_high_retention: float = 30.0
    cluster_medium_revenue: float = 5.0
    cluster_medium_retention: float = 20.0
    cluster_risk_share: float = 0.2

    # anchored sessions
    bucket_minutes: int = 360
    max_bucket: int = 4
    session_compare_k: int = 20
    session_user_min_events: int = 10
    session_user_classes: tuple[int, int, int] = (100, 50, 20)
    session_daily_k: int = 10
    gaming_min_events: int = 10
    gaming_report_min_events: int = 15
    gaming_k: int = 50
    gaming_likely: tuple[int, int] = (50, 60)        # more than N events within fewer than M minutes
    gaming_possible: tuple[int, int] = (30, 2)       # more than N events within at most H distinct hours
    gaming_suspicious: tuple[int, int] = (20, 30)    # more than N events within fewer than M minutes

    # RFM
    rfm_quantiles: tuple[float, float, float] = (0.25, 0.5, 0.75)
    recency_mode: str = "original"     # "original" ranks recency descending, "corrected" ascending
    rfm_distribution_k: int = 20
    rfm_country_min_customers: int = 10

    # KPIs
    engagement_classes: tuple[int, int, int, int] = (100, 50, 20, 5)
    churn_days: tuple[int, int, int] = (7, 30, 90)
    clv_classes: tuple[float, float, float, float] = (100.0, 50.0, 10.0, 0.0)
    os_min_users: int = 10

    # activity reports
    rolling_days: tuple[int, ...] = (7, 28)
    sketch_lg_k: int = 14              # log2 of the registers of a distinct-user sketch
    snapshot_days: int = 30            # days between the two snapshots of the account change reports
    diff_buckets: int = 65_536         # physical: buckets whose digests two snapshots compare
    life_bin_days: int = 7             # physical: width of the bins of interval and as-of joins

    # physical knobs (not semantics)
    dimension_max_rows: int | None = None  # None: Spark's size-based join choice; int: count-checked broadcast
    hot_key_rows: int = 1_000_000      # per-key row count above which a key is salted,
    hot_key_limit: int = 1_000_000     # if it also has more than 1 / hot_key_limit of all rows
    salt_rows_per_task: int = 1_000_000

    def with_(self, **changes) -> "Params":
        return dataclasses.replace(self, **changes)


DEFAULT = Params()
