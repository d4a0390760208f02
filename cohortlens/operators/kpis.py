"""Business KPIs over accounts and events.

Account x event reports join ``user_info`` to events on ``user_id``
(many accounts per user, so every event repeats per account).  Both
sides are reduced first — events to one row per user
(``plans.fanout.events_per_user``), accounts to one row per report group
and user — and the joined totals are rebuilt from counts.  Accounts
without a user are then one row per report group
(``plans.fanout.join_user_events``).

Averages of money and ratios are accumulated exactly (``exact_avg``) so
they do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (date_lit, days_between_ts, div, exact_avg, exact_sum, first_match, life_days,
                                 order_key, pct, rnd)
from ..functions.labels import CHURN_STATUSES, CLV_SEGMENTS, ENGAGEMENT_SEGMENTS, PLATFORMS
from ..params import DEFAULT, Params
from ..plans.fanout import join_user_events, left_weight, per_user_totals, rows_per
from ..plans.cells import weighted_percentile_cont, with_row


def dau_by_platform(events: DataFrame) -> DataFrame:
    daily = events.groupBy("date", "platform").agg(
        F.countDistinct("user_id").alias("dau"), F.sum("volume").alias("_v"), F.sum("fee").alias("_f"))
    dau = F.col("dau")
    return (daily.groupBy("date").agg(
        *[F.sum(F.when(F.col("platform") == p, dau).otherwise(F.lit(0))).alias(f"{p}_dau") for p in PLATFORMS],
        F.sum(dau).alias("total_dau"),
        F.sum("_f").alias("total_daily_revenue"),
        F.sum("_v").alias("total_daily_volume"))
        .orderBy("date"))


def mau_growth(events: DataFrame) -> DataFrame:
    monthly = events.groupBy(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month")).agg(
        F.countDistinct("user_id").alias("mau"), F.sum("fee").alias("_rev"), F.sum("volume").alias("_vol"))
    by_month = Window.orderBy("year", "month")  # one row per month
    prev_mau, prev_rev = F.lag("mau").over(by_month), F.lag("_rev").over(by_month)
    return monthly.select(
        "year", "month", "mau",
        rnd("_rev", 2).alias("monthly_revenue"),
        rnd("_vol", 0).alias("monthly_volume"),
        F.when(prev_mau.isNotNull(), rnd(pct(F.col("mau") - prev_mau, prev_mau), 2)).alias("mau_growth_rate"),
        F.when(prev_rev.isNotNull(), rnd(pct(F.col("_rev") - prev_rev, prev_rev), 2)).alias("revenue_growth_rate"),
    ).orderBy("year", "month")


def acquisition_by_month(user_info: DataFrame) -> DataFrame:
    agg = (user_info.filter(F.col("created_date").isNotNull())
           .groupBy(F.trunc("created_date", "MM").alias("acquisition_month"))
           .agg(F.count(F.lit(1)).alias("new_users"),
                *[F.count(F.when(F.col("platform") == p, F.lit(1))).alias(f"{p}_acquisitions") for p in PLATFORMS]))
    return agg.select(
        "acquisition_month", "new_users", *[f"{p}_acquisitions" for p in PLATFORMS],
        *[rnd(pct(f"{p}_acquisitions", "new_users"), 1).alias(f"{p}_acquisition_rate") for p in PLATFORMS],
    ).orderBy("acquisition_month")


def revenue_metrics(user_info: DataFrame, events: DataFrame, per_user: DataFrame | None = None) -> DataFrame:
    """One row.  The median is PERCENTILE_CONT(0.5) of fee over the joined
    rows, i.e. each event weighted by its user's number of accounts."""
    acc = rows_per(user_info.filter(F.col("user_id").isNotNull()), ["user_id"])
    j = join_user_events(acc, per_user_totals(events, per_user))
    a = F.col("_a")
    totals = j.agg(
        F.count("user_id").alias("total_users"),
        F.count(F.when(F.col("ev_rows").isNotNull(), F.col("user_id"))).alias("paying_users"),
        F.sum(a * F.col("ev_fee")).alias("_rev"),
        F.sum(a * F.col("ev_fee_rows")).alias("_nfee"),
        F.coalesce(F.sum(a * F.col("ev_ids")), F.lit(0)).alias("total_transactions"))
    fee_counts = (events.filter(F.col("user_id").isNotNull() & F.col("fee").isNotNull())
                  .groupBy("user_id", "fee").agg(F.count(F.lit(1)).alias("_k")))
    weighted = fee_counts.join(acc, "user_id").select("fee", (F.col("_k") * F.col("_a")).alias("_w"))
    return with_row(totals, weighted_percentile_cont(weighted, "fee", "_w", 0.5, "_median")).select(
        "total_users", "paying_users",
        rnd(pct("paying_users", "total_users"), 2).alias("conversion_rate"),
        rnd("_rev", 2).alias("total_revenue"),
        rnd(div("_rev", "paying_users"), 2).alias("arpu"),
        rnd(div("_rev", "_nfee"), 2).alias("avg_transaction_value"),
        rnd("_median", 2).alias("median_transaction_value"),
        "total_transactions",
        rnd(div("total_transactions", "paying_users"), 2).alias("avg_transactions_per_user"))


def feature_usage(user_info: DataFrame, events: DataFrame, per_user: DataFrame | None = None) -> DataFrame:
    acc = rows_per(user_info.filter(F.col("feature").isNotNull()), ["feature", "user_id"])
    j = join_user_events(acc, per_user_totals(events, per_user))
    a = F.col("_a")
    agg = j.groupBy("feature").agg(
        F.count("user_id").alias("users_with_feature"),
        F.count(F.when(F.col("ev_rows").isNotNull(), F.col("user_id"))).alias("active_users_with_feature"),
        F.coalesce(F.sum(a * F.col("ev_fee")), F.lit(0)).alias("_rev"),
        F.coalesce(F.sum(a * F.col("ev_ids")), F.lit(0)).alias("events_from_feature"))
    return agg.select(
        "feature", "users_with_feature", "active_users_with_feature",
        rnd(pct("active_users_with_feature", "users_with_feature"), 2).alias("feature_activation_rate"),
        rnd("_rev", 2).alias("feature_revenue"),
        rnd(div("_rev", "active_users_with_feature"), 2).alias("revenue_per_active_user"),
        "events_from_feature",
        rnd(div("events_from_feature", "active_users_with_feature"), 2).alias("events_per_active_user"),
    ).orderBy(F.col("feature_revenue").desc())


def engagement_segments(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Users (including the no-user group) by event volume.  Distinct active
    days come from a (user, day) pre-aggregation, skew-safe for heavy users."""
    per_day = (events.groupBy("user_id", F.to_date("datetime").alias("_day"))
               .agg(F.count("id").alias("_n"), F.sum("volume").alias("_v"), F.sum("fee").alias("_f"),
                    F.min("datetime").alias("_first"), F.max("datetime").alias("_last")))
    users = per_day.groupBy("user_id").agg(
        F.count("_day").alias("active_days"), F.sum("_n").alias("total_events"),
        F.sum("_v").alias("total_volume"), F.sum("_f").alias("total_revenue"),
        (days_between_ts(F.min("_first"), F.max("_last")) + 1).cast("long").alias("user_lifetime_days"))
    c = params.engagement_classes
    n = F.col("total_events")
    segment = first_match([(n >= c[i], F.lit(ENGAGEMENT_SEGMENTS[i])) for i in range(4)], F.lit(ENGAGEMENT_SEGMENTS[4]))
    ratio = div("active_days", "user_lifetime_days")
    return (users.groupBy(segment.alias("user_segment"))
            .agg(F.count(F.lit(1)).alias("user_count"),
                 rnd(F.avg("active_days"), 1).alias("avg_active_days"),
                 rnd(F.avg("total_events"), 1).alias("avg_total_events"),
                 rnd(F.avg("total_volume"), 1).alias("avg_total_volume"),
                 rnd(div(F.sum("total_revenue"), F.count("total_revenue")), 2).alias("avg_total_revenue"),
                 rnd(F.avg("user_lifetime_days"), 1).alias("avg_lifetime_days"),
                 rnd(exact_avg(ratio), 3).alias("avg_engagement_ratio"))
            .orderBy(F.col("avg_total_revenue").desc_nulls_last()))


def churn_status(user_info: DataFrame, events: DataFrame, params: Params = DEFAULT,
                 per_user: DataFrame | None = None) -> DataFrame:
    """One row per (status, platform).  The status depends on the account alone,
    so accounts become one row per (user, platform, status) before the join:
    ``_g`` (user, dates, platform) groups with ``_a`` accounts."""
    acc = rows_per(user_info.filter(F.col("platform").isNotNull()),
                   ["user_id", "created_date", "last_login", "platform"])
    since = F.datediff(date_lit(params.as_of), F.coalesce(F.col("last_login"), F.col("created_date")))
    d = params.churn_days
    status = first_match([(since <= d[0], F.lit(CHURN_STATUSES[0])), (since <= d[1], F.lit(CHURN_STATUSES[1])),
                          (since <= d[2], F.lit(CHURN_STATUSES[2]))], F.lit(CHURN_STATUSES[3]))
    life = life_days(params.as_of)
    acc = acc.groupBy("user_id", "platform", status.alias("churn_status")).agg(
        F.count(F.lit(1)).alias("_g"), F.sum("_a").alias("_a"), F.sum(life).alias("_ls"), F.count(life).alias("_lc"))
    j = join_user_events(acc, per_user_totals(events, per_user))
    a, g = F.col("_a"), F.col("_g")
    agg = j.groupBy("churn_status", "platform").agg(
        F.sum(g).alias("user_count"), div(F.sum("_ls"), F.sum("_lc")).alias("_act"),
        div(F.sum(a * F.coalesce(F.col("ev_ids"), F.lit(0))), F.sum(g)).alias("_ev"),
        div(F.sum(a * F.col("ev_fee")), F.sum(F.when(F.col("ev_fee").isNotNull(), g))).alias("_avg_rev"))
    everyone = Window.partitionBy()  # at most 4 statuses x platforms
    return agg.select(
        "churn_status", "platform", "user_count",
        rnd(pct("user_count", F.sum("user_count").over(everyone)), 2).alias("percentage"),
        rnd("_act", 1).alias("avg_days_active"),
        rnd("_ev", 1).alias("avg_events"),
        rnd("_avg_rev", 2).alias("avg_revenue"),
    ).orderBy(order_key("churn_status", CHURN_STATUSES), "platform")


def _account_event_summary(user_info: DataFrame, events: DataFrame, key: str, params: Params,
                           per_user: DataFrame | None = None) -> DataFrame:
    """Per ``key`` value: users, active users, events, revenue, volume and the
    event-weighted average account life (shared by platform and os KPIs)."""
    life = life_days(params.as_of)
    acc = rows_per(user_info.filter(F.col(key).isNotNull()), [key, "user_id"],
                    _ls=F.sum(life), _lc=F.count(life))
    j = join_user_events(acc, per_user_totals(events, per_user))
    a, w = F.col("_a"), left_weight()
    return j.groupBy(key).agg(
        F.count("user_id").alias("total_users"),
        F.count(F.when(F.col("ev_rows").isNotNull(), F.col("user_id"))).alias("active_users"),
        F.coalesce(F.sum(a * F.col("ev_ids")), F.lit(0)).alias("total_events"),
        F.sum(a * F.col("ev_fee")).alias("_rev"),
        F.sum(a * F.col("ev_volume")).alias("_vol"),
        div(F.sum(F.col("_ls") * w), F.sum(F.col("_lc") * w)).alias("_life"))


def platform_kpis(user_info: DataFrame, events: DataFrame, params: Params = DEFAULT,
                  per_user: DataFrame | None = None) -> DataFrame:
    s = _account_event_summary(user_info, events, "platform", params, per_user)
    return s.select(
        "platform", "total_users", "active_users",
        rnd(pct("active_users", "total_users"), 2).alias("activation_rate"),
        "total_events",
        rnd("_rev", 2).alias("total_revenue"),
        rnd("_vol", 0).alias("total_volume"),
        rnd(div("_rev", "active_users"), 2).alias("revenue_per_active_user"),
        rnd(div("total_events", "active_users"), 2).alias("events_per_active_user"),
        rnd("_life", 1).alias("avg_user_lifetime_days"),
        rnd(div("_rev", "total_users"), 2).alias("revenue_per_total_user"),
    ).orderBy(F.col("total_revenue").desc_nulls_last())


def weekly_trends(events: DataFrame) -> DataFrame:
    weekly = events.groupBy(F.trunc("date", "week").alias("week_start")).agg(
        F.countDistinct("user_id").alias("weekly_active_users"), F.count(F.lit(1)).alias("weekly_events"),
        F.sum("fee").alias("_rev"), F.sum("volume").alias("_vol"))
    prev = F.lag("weekly_active_users").over(Window.orderBy("week_start"))  # one row per week
    return weekly.select(
        "week_start", "weekly_active_users", "weekly_events",
        rnd("_rev", 2).alias("weekly_revenue"),
        rnd("_vol", 0).alias("weekly_volume"),
        prev.alias("prev_week_users"),
        rnd(pct(F.col("weekly_active_users") - prev, prev), 2).alias("user_growth_rate"),
        rnd(div("_rev", "weekly_active_users"), 2).alias("revenue_per_user_weekly"),
    ).orderBy("week_start")


def clv_segments(user_info: DataFrame, events: DataFrame, params: Params = DEFAULT,
                 per_user: DataFrame | None = None) -> DataFrame:
    """One row per (band, platform).  Band and daily rate depend on an account
    group's size and life in days, so groups of equal size and life become one
    row with ``_g`` of them: a user has as many rows as such pairs, however
    many accounts."""
    acc = rows_per(user_info.filter(F.col("platform").isNotNull()),
                   ["user_id", "platform", "created_date", "last_login"])
    acc = rows_per(acc, ["user_id", "platform", "_a", life_days(params.as_of).alias("_life")], "_g")
    j = join_user_events(acc, per_user_totals(events, per_user))
    a, g = F.col("_a"), F.col("_g")
    rows = j.select(
        "platform", "_g", "_life",
        (a * F.coalesce(F.col("ev_ids"), F.lit(0))).alias("_tx"),
        F.coalesce(a * F.col("ev_fee"), F.lit(0)).alias("_rev"))
    c = params.clv_classes
    rev = F.col("_rev")
    segment = first_match([(rev >= c[0], F.lit(CLV_SEGMENTS[0])), (rev >= c[1], F.lit(CLV_SEGMENTS[1])),
                           (rev >= c[2], F.lit(CLV_SEGMENTS[2])), (rev > c[3], F.lit(CLV_SEGMENTS[3]))],
                          F.lit(CLV_SEGMENTS[4]))
    daily = div("_rev", "_life")
    agg = rows.groupBy(segment.alias("clv_segment"), "platform").agg(
        F.sum(g).alias("user_count"),
        rnd(div(F.sum(g * F.col("_life")), F.sum(F.when(F.col("_life").isNotNull(), g))), 1).alias("avg_lifetime_days"),
        rnd(div(F.sum(g * F.col("_tx")), F.sum(g)), 1).alias("avg_transactions"),
        rnd(div(F.sum(g * rev), F.sum(g)), 2).alias("avg_revenue"),
        rnd(F.sum(g * rev), 2).alias("segment_total_revenue"),
        rnd(div(exact_sum(daily, g), F.sum(F.when(daily.isNotNull(), g))), 3).alias("avg_daily_revenue"))
    return agg.orderBy(order_key("clv_segment", CLV_SEGMENTS), "platform")


def os_performance(user_info: DataFrame, events: DataFrame, params: Params = DEFAULT,
                   per_user: DataFrame | None = None) -> DataFrame:
    s = (_account_event_summary(user_info, events, "os", params, per_user)
         .filter(F.col("total_users") >= params.os_min_users))
    return s.select(
        "os", "total_users", "active_users",
        rnd(pct("active_users", "total_users"), 2).alias("activation_rate"),
        rnd("_rev", 2).alias("total_revenue"),
        rnd(div("_rev", "active_users"), 2).alias("revenue_per_active_user"),
        rnd(div("total_events", "active_users"), 2).alias("events_per_active_user"),
        rnd("_life", 1).alias("avg_retention_days"),
    ).orderBy(F.col("total_revenue").desc_nulls_last())


def peak_hours(events: DataFrame) -> DataFrame:
    hourly = events.groupBy(F.hour("datetime").cast("long").alias("hour_of_day")).agg(
        F.countDistinct("user_id").alias("unique_users"), F.count(F.lit(1)).alias("total_events"),
        F.sum("fee").alias("_rev"), F.sum("volume").alias("_vol"))
    busiest = Window.orderBy(F.col("total_events").desc())  # at most 25 rows
    return hourly.select(
        "hour_of_day", "unique_users", "total_events",
        rnd("_rev", 2).alias("hourly_revenue"),
        rnd("_vol", 0).alias("hourly_volume"),
        rnd(div("total_events", "unique_users"), 2).alias("events_per_user_per_hour"),
        F.rank().over(busiest).cast("long").alias("usage_rank"),
    ).orderBy("hour_of_day")


def cohort_revenue(user_info: DataFrame, events: DataFrame, per_user: DataFrame | None = None) -> DataFrame:
    acc = rows_per(user_info.filter(F.col("created_date").isNotNull()),
                    [F.trunc("created_date", "MM").alias("cohort_month"), "user_id"])
    j = join_user_events(acc, per_user_totals(events, per_user))
    a = F.col("_a")
    rows = j.select("cohort_month",
                    F.coalesce(a * F.col("ev_fee"), F.lit(0)).alias("_rev"),
                    (a * F.coalesce(F.col("ev_ids"), F.lit(0))).alias("_events"))
    paying = F.count(F.when(F.col("_rev") > 0, F.lit(1)))
    agg = rows.groupBy("cohort_month").agg(
        F.count(F.lit(1)).alias("cohort_size"), paying.alias("paying_users"),
        F.sum("_rev").alias("_sum"), F.avg("_events").alias("_avg_events"))
    return agg.select(
        "cohort_month", "cohort_size", "paying_users",
        rnd(pct("paying_users", "cohort_size"), 2).alias("conversion_rate"),
        rnd("_sum", 2).alias("cohort_total_revenue"),
        rnd(div("_sum", "cohort_size"), 2).alias("avg_revenue_per_user"),
        rnd(div("_sum", "paying_users"), 2).alias("avg_revenue_per_paying_user"),
        rnd("_avg_events", 1).alias("avg_events_per_user"),
    ).orderBy("cohort_month")
