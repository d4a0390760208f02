"""Recency / frequency / monetary scoring and segment reports.

``rfm_base`` joins recalculated events to accounts on ``user_id`` (one
row per (user, created_date), totals multiplied by the number of such
accounts, as the join does) after reducing events to one row per user.
Its three row numbers come from cells of values (``plans.cells``): one
shuffle by cell a number, nothing expanded or written.

``rfm_scores`` compares each value with the value found at row
``round(p * N)`` of each ordering.  In the default ``original`` mode
recency is ordered descending while the CASE assumes ascending
thresholds, so R only takes the values 1 and 4; ``corrected`` orders
recency ascending.  The nine thresholds are order statistics of three value
columns found together, without row numbers, and join the scoring as one row
(no job before the caller's action).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_lit, dbl, div, exact_avg, exact_sum, first_match, month_boundaries, pct, rnd
from ..functions.labels import SEG_AT_RISK, SEG_OTHER, SEG_POTENTIAL, SEG_REGULAR, SEG_VIP, SEG_WALK_IN
from ..params import DEFAULT, Params
from ..plans.broadcast import dimension
from ..plans.cells import numbered, order_statistics, with_row

BASE_COLS = ["user_id", "created_date", "recency", "frequency", "monetary"]


def rfm_values(events_updated: DataFrame, user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The metrics of ``rfm_base`` without row numbers: all that scores and
    segments need.  ``events_updated`` may come with or without ``id``."""
    n_col = F.count("id") if "id" in events_updated.columns else F.count(F.lit(1))
    per_user = (events_updated.filter(F.col("user_id").isNotNull()).groupBy("user_id")
                .agg(n_col.alias("_n"), F.sum("fee").alias("_f"), F.max("date").alias("_last")))
    accounts = (user_info.filter(F.col("user_id").isNotNull())
                .groupBy("user_id", "created_date").agg(F.count(F.lit(1)).alias("_a")))
    months = month_boundaries(params.as_of)
    return accounts.join(per_user, "user_id").select(
        "user_id", "created_date",
        F.datediff(date_lit(params.as_of), F.col("_last")).cast("long").alias("recency"),
        div(F.col("_a") * F.col("_n"), months).alias("frequency"),
        div(F.col("_a") * F.col("_f"), months).alias("monetary"))


def _orders(params: Params) -> dict[str, tuple[F.Column, bool]]:
    """metric -> (value to rank ascending, nulls first): recency is descending
    with nulls last in original mode, the others ascend with nulls first."""
    original = params.recency_mode == "original"
    recency = dbl("recency")
    return {"recency": (-recency if original else recency, not original),
            "frequency": (dbl("frequency"), True), "monetary": (dbl("monetary"), True)}


def rfm_base(events_updated: DataFrame, user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(CTAS ``rfm_base``)  ``rfm_values`` with the three row numbers."""
    ranks = {f"{m}_rn": order for m, order in _orders(params).items()}
    out = numbered(rfm_values(events_updated, user_info, params), ranks, ["user_id", "created_date"])
    return out.select(*BASE_COLS, *ranks)


def _score(value: F.Column, t: list[F.Column]) -> F.Column:
    return first_match([
        (value < t[0], F.lit(1)),
        ((value >= t[0]) & (value < t[1]), F.lit(2)),
        ((value >= t[1]) & (value < t[2]), F.lit(3)),
    ], F.lit(4)).cast("long")


METRICS = ("recency", "frequency", "monetary")


def threshold_row(base: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row, columns ``{metric}{i}``: for each metric, the value at row
    ``round(p_i * N)`` of its ordering (``CAST(p * N AS INT64)`` rounds half
    away from zero); null where that row does not exist.

    A ``base`` with row numbers (a written ``rfm_base``) is asked for those rows;
    else the values are selected from cells."""
    ranks = [f"{m}_rn" for m in METRICS]
    if set(ranks) <= set(base.columns):
        counted = with_row(base, base.agg(F.count(F.lit(1)).alias("_rows")))
        return counted.agg(*[
            F.max(F.when(F.col(f"{m}_rn") == F.floor(F.lit(float(p)) * F.col("_rows") + F.lit(0.5)), F.col(m))).alias(f"{m}{i}")
            for m in METRICS for i, p in enumerate(params.rfm_quantiles)])
    found = order_statistics(base, _orders(params), params.rfm_quantiles)
    recency = -1 if params.recency_mode == "original" else 1
    return found.select(*[(F.col(f"{m}{i}") * recency).cast("long").alias(f"{m}{i}") if m == "recency" else F.col(f"{m}{i}")
                          for m in METRICS for i in range(len(params.rfm_quantiles))])


def rfm_thresholds(base: DataFrame, params: Params = DEFAULT) -> dict[str, list]:
    """The nine thresholds as values (runs the query; for inspection)."""
    row = threshold_row(base, params).first()
    return {m: [row[f"{m}{i}"] for i in range(len(params.rfm_quantiles))] for m in METRICS}


def rfm_scores(base: DataFrame, params: Params = DEFAULT, cut: DataFrame | None = None) -> DataFrame:
    """(CTAS ``rfm_scores``)  ``base`` with or without row numbers; ``cut``: its
    ``threshold_row``, where that is known from a cheaper table."""
    cut = threshold_row(base, params) if cut is None else cut
    t = {m: [F.col(f"_{m}{i}") for i in range(len(params.rfm_quantiles))] for m in METRICS}
    return with_row(base, cut.select(*[F.col(c).alias(f"_{c}") for c in cut.columns])).select(
        *base.columns,
        _score(F.col("recency"), t["recency"]).alias("R"),
        _score(F.col("frequency"), t["frequency"]).alias("F"),
        _score(F.col("monetary"), t["monetary"]).alias("M"))


def rfm_segments(scores: DataFrame) -> DataFrame:
    """(CTAS ``rfm_segments``)  Scores 1-2 are low, 3-4 high: low frequency
    and spend -> walk-in guests; low frequency, high spend -> potential;
    otherwise (high frequency) stale high-recency scores split regular /
    VIP by spend, and low recency scores are at risk.  A missing score that
    the class depends on gives the class ``Other``."""
    r, f, m = F.col("R"), F.col("F"), F.col("M")
    low_r, low_f, low_m = r <= 2, f <= 2, m <= 2
    segment = first_match([
        (r.isNotNull() & low_f & low_m, F.lit(SEG_WALK_IN)),
        (r.isNotNull() & low_f & ~low_m, F.lit(SEG_POTENTIAL)),
        (~low_r & ~low_f & low_m, F.lit(SEG_REGULAR)),
        (~low_r & ~low_f & ~low_m, F.lit(SEG_VIP)),
        (low_r & ~low_f, F.lit(SEG_AT_RISK)),
    ], F.lit(SEG_OTHER))
    return scores.select(
        *BASE_COLS, "R", "F", "M",
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_score"),
        segment.alias("customer_segment"))


def segment_summary(segments: DataFrame) -> DataFrame:
    agg = segments.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("recency").alias("_r"), exact_avg("frequency").alias("_f"), exact_avg("monetary").alias("_m"),
        exact_sum("monetary").alias("_sm"))
    everyone = Window.partitionBy()  # one row per segment
    return agg.select(
        "customer_segment", "customer_count",
        rnd(pct("customer_count", F.sum("customer_count").over(everyone)), 2).alias("percentage"),
        rnd("_r", 2).alias("avg_recency"), rnd("_f", 2).alias("avg_frequency"),
        rnd("_m", 2).alias("avg_monetary"), rnd("_sm", 2).alias("total_revenue_contribution"),
    ).orderBy(F.col("customer_count").desc())


def rfm_score_distribution(segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    agg = segments.groupBy("rfm_score", "customer_segment").agg(F.count(F.lit(1)).alias("count"))
    everyone = Window.partitionBy()  # at most 64 score combinations
    return (agg.select("rfm_score", "customer_segment", "count",
                       rnd(pct("count", F.sum("count").over(everyone)), 2).alias("percentage"))
            .orderBy(F.col("count").desc(), "rfm_score", "customer_segment")
            .limit(params.rfm_distribution_k))


def _weighted(segments: DataFrame, accounts: DataFrame, keys: list[str], metrics: dict[str, str],
              count_name: str) -> DataFrame:
    """Aggregate segments joined to accounts (one row per account) without the
    fan-out: segments become one row per (user, segment) with their sums,
    accounts one row per (user, group) with their number ``_a``, and the joined
    totals are products of both."""
    per_user = segments.groupBy("user_id", "customer_segment").agg(
        F.count(F.lit(1)).alias("_k"),
        *[exact_sum(m).alias(f"_s_{out}") for out, m in metrics.items()],
        *[F.count(m).alias(f"_n_{out}") for out, m in metrics.items()])
    a = F.col("_a")
    aggs = [F.sum(a * F.col("_k")).alias(count_name)]
    for out in metrics:
        aggs += [exact_sum(f"_s_{out}", a).alias(f"_s_{out}"), F.sum(a * F.col(f"_n_{out}")).alias(f"_n_{out}")]
    return per_user.join(accounts, "user_id").groupBy(*keys).agg(*aggs)


def segment_by_country(segments: DataFrame, user_info: DataFrame, geography: DataFrame,
                       params: Params = DEFAULT) -> DataFrame:
    accounts = (user_info.filter(F.col("user_id").isNotNull())
                .groupBy("user_id", "mp_country_code").agg(F.count(F.lit(1)).alias("_a")))
    g = dimension(geography.select("code", "country"), params.dimension_max_rows)
    accounts = (accounts.join(g, accounts["mp_country_code"] == g["code"])
                .groupBy("user_id", "country").agg(F.sum("_a").alias("_a")))
    agg = (_weighted(segments, accounts, ["country", "customer_segment"], {"m": "monetary"}, "customer_count")
           .filter(F.col("customer_count") >= params.rfm_country_min_customers))
    return agg.select(
        "country", "customer_segment", "customer_count",
        rnd(div("_s_m", "_n_m"), 2).alias("avg_monetary_value"),
        rnd("_s_m", 2).alias("total_revenue"),
    ).orderBy("country", F.col("total_revenue").desc_nulls_last())


def segment_by_platform(segments: DataFrame, user_info: DataFrame) -> DataFrame:
    accounts = (user_info.filter(F.col("user_id").isNotNull() & F.col("platform").isNotNull())
                .groupBy("user_id", "platform").agg(F.count(F.lit(1)).alias("_a")))
    agg = _weighted(segments, accounts, ["platform", "customer_segment"],
                    {"f": "frequency", "m": "monetary"}, "customer_count")
    return agg.select(
        "platform", "customer_segment", "customer_count",
        rnd(div("_s_f", "_n_f"), 2).alias("avg_frequency"),
        rnd(div("_s_m", "_n_m"), 2).alias("avg_monetary"),
    ).orderBy("platform", F.col("customer_count").desc())


def segment_lifecycle(segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    agg = segments.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg(F.datediff(date_lit(params.as_of), F.col("created_date"))).alias("_age"),
        F.avg("recency").alias("_rec"), exact_avg("frequency").alias("_freq"), exact_avg("monetary").alias("_rev"))
    return agg.select(
        "customer_segment", "total_customers",
        rnd("_age", 1).alias("avg_customer_age_days"),
        rnd("_rec", 1).alias("avg_days_since_last_use"),
        rnd("_freq", 2).alias("avg_monthly_frequency"),
        rnd("_rev", 2).alias("avg_monthly_revenue"),
        rnd(dbl("_rev") * dbl("_freq"), 2).alias("estimated_monthly_clv"),
    ).orderBy(F.col("estimated_monthly_clv").desc_nulls_last())


def segment_transitions(segments: DataFrame) -> DataFrame:
    """Two rows from one pass.  The second row is positioned like the first
    (its 'from_potential' count sits under ``from_regular``), as a
    positional UNION ALL does."""
    seg = F.col("customer_segment")
    counts = segments.agg(*[F.count(F.when(seg == s, F.lit(1))).alias(a) for s, a in
                            ((SEG_REGULAR, "_reg"), (SEG_POTENTIAL, "_pot"), (SEG_AT_RISK, "_risk"),
                             (SEG_WALK_IN, "_walk"))])
    return counts.select(F.expr(
        f"stack(2, '{SEG_VIP}', _reg, _pot, _risk, '{SEG_REGULAR}', _pot, _walk, _risk) "
        "AS (target_segment, from_regular, from_potential, from_at_risk)"))
