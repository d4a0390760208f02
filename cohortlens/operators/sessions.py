"""Anchored six-hour session recalculation and its impact reports.

Events of one (user, platform, date) are bucketed by their offset from
the group's *first* event: [0, 6h) -> 1, [6h, 12h] -> 2, (12h, 18h] -> 3,
anything later (or a NULL time) -> 4.  Neither ``window`` nor
``session_window`` gives this anchoring, so the group minimum comes
from one window whose hot groups are salted (``plans.skew``), the buckets are
aggregated in the window's tasks before they are shuffled, and the global
``id`` is a row number over cells of users (``plans.cells``).

The impact reports need, per (user, platform, date), the original and
the recalculated event counts.  Both come out of the same bucket
aggregation (original = events summed over buckets, recalculated =
number of buckets), so no second pass over the events and no join of
two aggregates is needed.  Volume and fee are conserved by the
recalculation, so the original and updated sums are the same column.
The ``date`` column is the events' ``date`` (equal to ``DATE(datetime)``
for well-formed events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div, first_match, minutes_between, pct, rnd
from ..functions.labels import (GAMING_LIKELY, GAMING_NORMAL, GAMING_POSSIBLE, GAMING_SUSPICIOUS,
                                SESSION_USER_CATEGORIES)
from ..params import DEFAULT, Params
from ..plans.cells import numbered
from ..plans.skew import attach_group_min

SESSION_KEY = ["user_id", "platform", "date"]


def _bucket(params: Params) -> F.Column:
    t, m = F.col("datetime"), F.col("_first")

    def edge(k: int) -> F.Column:
        return m + F.expr(f"INTERVAL {k * params.bucket_minutes} MINUTES")

    cases = [(t < edge(1), F.lit(1))]
    cases += [(t.between(edge(k - 1), edge(k)), F.lit(k)) for k in range(2, params.max_bucket)]
    return first_match(cases, F.lit(params.max_bucket))


def session_buckets(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per (user, day, platform, bucket) with first time, sums
    and the number of events folded into it.  Buckets are anchored within the ``date`` column; a session's own ``date``
    is the day of its ``datetime`` (null for a null time)."""
    known = events.filter(F.col("user_id").isNotNull()).select(
        "id", "user_id", "platform", "date", "datetime", "volume", "fee")
    anchored = attach_group_min(known, SESSION_KEY, "datetime", "_first",
                                hot_key_rows=params.hot_key_rows, hot_key_limit=params.hot_key_limit,
                                salt_rows_per_task=params.salt_rows_per_task)
    return (anchored.withColumn("_grp", _bucket(params)).withColumn("date", F.to_date("datetime"))
            .groupBy("user_id", "date", "platform", "_grp")
            .agg(F.min("datetime").alias("datetime"), F.sum("volume").alias("volume"),
                 F.sum("fee").alias("fee"), F.count(F.lit(1)).alias("_events")))


def sessions(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Recalculated events without the global id (enough for per-user totals)."""
    return session_buckets(events, params).select("user_id", "date", "datetime", "platform", "volume", "fee")


def events_updated(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Recalculated events with ``id`` = 1..N by (user, date, bucket, platform).
    (CTAS ``events_updated``; platform is added to the order so ids are
    deterministic.)"""
    out = numbered(session_buckets(events, params).drop("_events"), {"id": (F.col("user_id"), True)}, ["date", "_grp", "platform"],
                   edges_from=events.filter(F.col("user_id").isNotNull()))
    return out.select("id", "user_id", "date", "datetime", "platform", "volume", "fee")


def session_key_stats(events: DataFrame, params: Params = DEFAULT,
                      events_updated: DataFrame | None = None) -> DataFrame:
    """Per (user, platform, date): original vs recalculated events and sums.
    Rows without a platform or date are dropped, as the equi-join on the
    three keys does.

    Stand-alone, both sides come from one pass: a bucket carries the number of
    events folded into it, so per key the buckets count the recalculated events
    and their contents the original ones; a bucket's volume and fee are the
    sums of its events, so their total is the total on either side.  With a
    written ``events_updated``, ``updated`` sums that table, each side one row
    per key, map-side combined, before they are joined."""
    known = F.col("platform").isNotNull() & F.col("date").isNotNull()
    if events_updated is None:
        return (session_buckets(events, params).filter(known).groupBy(*SESSION_KEY)
                .agg(F.sum("_events").alias("original_events"), F.sum("volume").alias("original_volume"),
                     F.sum("fee").alias("original_fee"), F.count(F.lit(1)).alias("updated_events"),
                     F.sum("volume").alias("updated_volume"), F.sum("fee").alias("updated_fee")))
    events = events.withColumn("date", F.to_date("datetime"))
    original = (events.filter(F.col("user_id").isNotNull() & known).groupBy(*SESSION_KEY)
                .agg(F.count(F.lit(1)).alias("original_events"), F.sum("volume").alias("original_volume"),
                     F.sum("fee").alias("original_fee")))
    updated = (events_updated.filter(known).groupBy(*SESSION_KEY)
               .agg(F.count(F.lit(1)).alias("updated_events"), F.sum("volume").alias("updated_volume"),
                    F.sum("fee").alias("updated_fee")))
    return original.join(updated, SESSION_KEY)


def _stats(events, params, events_updated, stats) -> DataFrame:
    return stats if stats is not None else session_key_stats(events, params, events_updated)


def session_compare(events: DataFrame, params: Params = DEFAULT, events_updated: DataFrame | None = None,
                    stats: DataFrame | None = None) -> DataFrame:
    st = _stats(events, params, events_updated, stats).filter(
        F.col("original_events") > F.col("updated_events"))
    reduced = F.col("original_events") - F.col("updated_events")
    return (st.select(
        *SESSION_KEY, "original_events", "updated_events", reduced.alias("events_reduced"),
        rnd(pct(reduced, "original_events"), 2).alias("reduction_percentage"),
        "original_volume", "updated_volume", "original_fee", "updated_fee")
        .orderBy(F.col("events_reduced").desc(), *SESSION_KEY)
        .limit(params.session_compare_k))


def session_user_impact(events: DataFrame, params: Params = DEFAULT, events_updated: DataFrame | None = None,
                        stats: DataFrame | None = None) -> DataFrame:
    st = _stats(events, params, events_updated, stats)
    reduced = F.col("original_events") - F.col("updated_events")
    users = (st.groupBy("user_id")
             .agg(F.sum("original_events").alias("_orig"), F.sum("updated_events").alias("_upd"),
                  F.sum(reduced).alias("_red"), rnd(F.avg(pct(reduced, "original_events")), 2).alias("_pct"))
             .filter(F.col("_orig") >= params.session_user_min_events))
    heavy, moderate, regular = params.session_user_classes
    o = F.col("_orig")
    category = first_match([(o >= heavy, F.lit(SESSION_USER_CATEGORIES[0])),
                            (o >= moderate, F.lit(SESSION_USER_CATEGORIES[1])),
                            (o >= regular, F.lit(SESSION_USER_CATEGORIES[2]))], F.lit(SESSION_USER_CATEGORIES[3]))
    return (users.groupBy(category.alias("user_category"))
            .agg(F.count(F.lit(1)).alias("user_count"),
                 rnd(F.avg("_orig"), 1).alias("avg_original_events"),
                 rnd(F.avg("_upd"), 1).alias("avg_updated_events"),
                 rnd(F.avg("_red"), 1).alias("avg_events_reduced"),
                 rnd(F.avg("_pct"), 2).alias("avg_reduction_percentage"))
            .orderBy(F.col("avg_original_events").desc()))


def session_platform_impact(events: DataFrame, params: Params = DEFAULT, events_updated: DataFrame | None = None,
                            stats: DataFrame | None = None) -> DataFrame:
    st = _stats(events, params, events_updated, stats)
    per_user = (st.groupBy("user_id", "platform")
                .agg(F.sum("original_events").alias("_orig"), F.sum("updated_events").alias("_upd"))
                .filter(F.col("_orig") > F.col("_upd")))
    agg = per_user.groupBy("platform").agg(
        F.count("user_id").alias("affected_users"),
        F.sum("_orig").alias("total_original_events"),
        F.sum("_upd").alias("total_updated_events"),
        F.sum(F.col("_orig") - F.col("_upd")).alias("total_events_reduced"))
    return agg.withColumn(
        "platform_reduction_pct", rnd(pct("total_events_reduced", "total_original_events"), 2)
    ).orderBy(F.col("platform_reduction_pct").desc_nulls_last())


def session_daily_impact(events: DataFrame, params: Params = DEFAULT, events_updated: DataFrame | None = None,
                         stats: DataFrame | None = None) -> DataFrame:
    st = _stats(events, params, events_updated, stats)
    daily = (st.groupBy("date")
             .agg(F.sum("original_events").alias("daily_original_events"),
                  F.sum("updated_events").alias("daily_updated_events"),
                  F.sum(F.col("original_events") - F.col("updated_events")).alias("daily_events_reduced"))
             .filter(F.col("daily_events_reduced") > 0))
    return (daily.withColumn("daily_reduction_pct",
                             rnd(pct("daily_events_reduced", "daily_original_events"), 2))
            .orderBy(F.col("daily_reduction_pct").desc(), "date")
            .limit(params.session_daily_k))


def gaming_patterns(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """High-frequency (user, platform, day) before recalculation, with an assessment.

    Distinct hours are counted with a 24-bit mask (``bit_or``), which is a
    plain partial aggregate instead of a distinct aggregation."""
    day = F.to_date("datetime").alias("date")
    hour_bit = F.expr("shiftleft(CAST(1 AS BIGINT), hour(datetime))")
    g = (events.filter(F.col("user_id").isNotNull())
         .groupBy("user_id", "platform", day)
         .agg(F.count(F.lit(1)).alias("daily_events"),
              F.coalesce(F.bit_count(F.bit_or(hour_bit)), F.lit(0)).cast("long").alias("unique_hours"),
              F.min("datetime").alias("_first"), F.max("datetime").alias("_last"))
         .filter(F.col("daily_events") >= params.gaming_min_events)
         .filter(F.col("daily_events") >= params.gaming_report_min_events))
    n, hrs = F.col("daily_events"), F.col("unique_hours")
    dur = F.col("session_duration_minutes")
    likely, possible, suspicious = params.gaming_likely, params.gaming_possible, params.gaming_suspicious
    assessment = first_match([
        ((n > likely[0]) & (dur < likely[1]), F.lit(GAMING_LIKELY)),
        ((n > possible[0]) & (hrs <= possible[1]), F.lit(GAMING_POSSIBLE)),
        ((n > suspicious[0]) & (dur < suspicious[1]), F.lit(GAMING_SUSPICIOUS)),
    ], F.lit(GAMING_NORMAL))
    return (g.withColumn("session_duration_minutes", minutes_between("_first", "_last").cast("long"))
            .select("user_id", "platform", "date", "daily_events", "unique_hours", "session_duration_minutes",
                    rnd(div("daily_events", "unique_hours"), 2).alias("events_per_hour"),
                    assessment.alias("gaming_assessment"))
            .orderBy(F.col("daily_events").desc(), F.col("session_duration_minutes").asc(),
                     "user_id", "platform", "date")
            .limit(params.gaming_k))
