"""Geographic reports.

``number_customer_country`` (NCC) holds one row per account with its
country.  The reports join it to accounts and events on ``user_id``,
which is many-to-many; see ``plans.fanout`` for how the joined totals
are rebuilt from per-user counts without materialising the product.

Top-k country lists are bounded by k, so they are broadcast without a
check; ties at the cut are broken by country name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dbl, div, first_match, life_days, pct, rnd
from ..functions.labels import (MARKET_HIGH_RISK, MARKET_HIGH_VALUE, MARKET_MEDIUM_VALUE, MARKET_STANDARD,
                                TIMEZONE_BANDS, TIMEZONE_UNKNOWN)
from ..params import DEFAULT, Params
from ..plans.broadcast import dimension
from ..plans.fanout import join_user_events, left_weight, per_user_totals, rows_per


def number_customer_country(user_info: DataFrame, geography: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Accounts with their country.  (CTAS ``number_customer_country``)"""
    g = dimension(geography, params.dimension_max_rows)
    return user_info.join(g, user_info["mp_country_code"] == g["code"]).select(
        user_info["user_id"], user_info["mp_country_code"].alias("country_code"),
        g["country"], g["latitude"], g["longitude"])


def _top_countries(ncc: DataFrame, k: int) -> DataFrame:
    top = (ncc.groupBy("country").agg(F.count("user_id").alias("_n"))
           .orderBy(F.col("_n").desc(), F.col("country").asc()).limit(k).select("country"))
    return F.broadcast(top)  # k rows


def top_countries(ncc: DataFrame, params: Params = DEFAULT) -> DataFrame:
    agg = ncc.groupBy("country").agg(F.count("user_id").alias("number_customers"))
    everyone = Window.partitionBy()  # one row per country
    return (agg.select("country", "number_customers",
                       rnd(pct("number_customers", F.sum("number_customers").over(everyone)), 2).alias("percentage"))
            .orderBy(F.col("number_customers").desc(), F.col("country").asc())
            .limit(params.top_countries_k))


def country_revenue(ncc: DataFrame, events: DataFrame, params: Params = DEFAULT,
                    per_user: DataFrame | None = None) -> DataFrame:
    acc = rows_per(ncc, ["country", "country_code", "user_id"], "_a")
    rows = join_user_events(acc, per_user_totals(events, per_user))
    a = F.col("_a")
    agg = (rows.groupBy("country", "country_code")
           .agg(F.count("user_id").alias("total_users"),
                F.count(F.when(F.col("ev_rows").isNotNull(), F.col("user_id"))).alias("active_users"),
                F.coalesce(F.sum(a * F.col("ev_fee")), F.lit(0)).alias("_rev"),
                F.coalesce(F.sum(a * F.col("ev_volume")), F.lit(0.0)).alias("_vol"),
                F.coalesce(F.sum(a * F.col("ev_ids")), F.lit(0)).alias("_events"))
           .filter(F.col("total_users") >= params.min_revenue_country_users))
    return agg.select(
        "country", "total_users", "active_users",
        rnd(pct("active_users", "total_users"), 2).alias("activation_rate"),
        rnd("_rev", 2).alias("total_revenue"),
        rnd(div("_rev", "active_users"), 2).alias("revenue_per_active_user"),
        rnd(div("_vol", "active_users"), 2).alias("volume_per_active_user"),
        rnd(div("_events", "active_users"), 2).alias("events_per_active_user"),
    ).orderBy(F.col("total_revenue").desc())


def _share_by_country(ncc: DataFrame, user_info: DataFrame, attr: str, out_count: str, out_share: str,
                      min_rows: int | None, countries: DataFrame | None) -> DataFrame:
    left = ncc.filter(F.col("user_id").isNotNull())
    if countries is not None:
        left = left.join(countries, "country", "left_semi")
    left = rows_per(left, ["user_id", "country"], "_a")
    right = rows_per(user_info.filter(F.col(attr).isNotNull() & F.col("user_id").isNotNull()),
                          ["user_id", attr], "_b")
    agg = (left.join(right, "user_id").groupBy("country", attr)
           .agg(F.sum(F.col("_a") * F.col("_b")).alias(out_count)))
    if min_rows is not None:
        agg = agg.filter(F.col(out_count) >= min_rows)
    in_country = Window.partitionBy("country")  # aggregated rows only
    return (agg.select("country", attr, out_count,
                       rnd(pct(out_count, F.sum(out_count).over(in_country)), 2).alias(out_share))
            .orderBy("country", F.col(out_count).desc()))


def country_platform_share(ncc: DataFrame, user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Platform mix per country; shares are of the groups that pass the minimum."""
    return _share_by_country(ncc, user_info, "platform", "users", "platform_share",
                             params.min_platform_share_users, None)


def os_by_top_countries(ncc: DataFrame, user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return _share_by_country(ncc, user_info, "os", "users", "os_share", None,
                             _top_countries(ncc, params.os_top_countries_k))


def country_engagement(ncc: DataFrame, user_info: DataFrame, events: DataFrame,
                       params: Params = DEFAULT, per_user: DataFrame | None = None) -> DataFrame:
    left = rows_per(ncc.filter(F.col("user_id").isNotNull()), ["country", "user_id"], "_a")
    # a report row is a (user, created, last login) group; its values are sums over
    # such groups, so a user's groups become one row: _g groups, _b accounts, lives
    life = life_days(params.as_of)
    mid = (rows_per(user_info.filter(F.col("user_id").isNotNull()), ["user_id", "created_date", "last_login"], "_b")
           .groupBy("user_id").agg(F.count(F.lit(1)).alias("_g"), F.sum("_b").alias("_b"),
                                   F.sum(life).alias("_ls"), F.count(life).alias("_lc")))
    rows = left.join(mid, "user_id").join(per_user_totals(events, per_user), "user_id", "left")
    g, mult = F.col("_g"), F.col("_a") * F.col("_b")
    seen = F.coalesce(F.col("ev_ids"), F.lit(0))

    def groups(where: F.Column) -> F.Column:
        return F.sum(F.when(where, g))

    agg = (rows.groupBy("country")
           .agg(F.sum(g).alias("total_users"),
                div(F.sum("_ls"), F.sum("_lc")).alias("_avg_life"),
                div(F.sum(mult * seen), F.sum(g)).alias("_avg_events"),
                div(F.sum(mult * F.col("ev_volume")), groups(F.col("ev_volume").isNotNull())).alias("_avg_volume"),
                div(F.sum(mult * F.col("ev_fee")), groups(F.col("ev_fee").isNotNull())).alias("_avg_fee"),
                F.coalesce(groups(seen > 0), F.lit(0)).alias("engaged_users"))
           .filter(F.col("total_users") >= params.min_engagement_country_users))
    return agg.select(
        "country", "total_users",
        rnd("_avg_life", 1).alias("avg_user_lifespan_days"),
        rnd("_avg_events", 1).alias("avg_events_per_user"),
        rnd("_avg_volume", 1).alias("avg_volume_per_user"),
        rnd("_avg_fee", 2).alias("avg_revenue_per_user"),
        "engaged_users",
        rnd(pct("engaged_users", "total_users"), 2).alias("engagement_rate"),
    ).orderBy(F.col("avg_revenue_per_user").desc_nulls_last())


def seasonal_by_top_countries(ncc: DataFrame, events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Month-of-year activity (years folded together) in the top countries."""
    top = _top_countries(ncc, params.seasonal_top_countries_k)
    left = rows_per(ncc.filter(F.col("user_id").isNotNull()).join(top, "country", "left_semi"),
                         ["country", "user_id"], "_a")
    monthly = (events.filter(F.col("user_id").isNotNull())
               .groupBy("user_id", F.month("date").cast("long").alias("month"))
               .agg(F.count("id").alias("_n"), F.sum("volume").alias("_v"), F.sum("fee").alias("_f")))
    a = F.col("_a")
    return (left.join(monthly, "user_id").groupBy("country", "month")
            .agg(F.count("user_id").alias("active_users"),
                 F.sum(a * F.col("_n")).alias("total_events"),
                 F.sum(a * F.col("_v")).alias("total_volume"),
                 dbl(F.sum(a * F.col("_f"))).alias("total_revenue"))
            .orderBy("country", "month"))


def country_clusters(ncc: DataFrame, user_info: DataFrame, events: DataFrame,
                     params: Params = DEFAULT, per_user: DataFrame | None = None) -> DataFrame:
    """Country value/risk classes.  Coordinates come from NCC, which took them
    from the geography row of the same code."""
    left = rows_per(ncc.filter(F.col("user_id").isNotNull()),
                         ["country", "latitude", "longitude", "user_id"], "_a")
    life = life_days(params.as_of)
    users = (user_info.filter(F.col("user_id").isNotNull()).groupBy("user_id")
             .agg(F.count(F.lit(1)).alias("_c"), F.sum(life).alias("_ls"), F.count(life).alias("_lc"),
                  F.count(F.when(life <= params.trial_days, F.lit(1))).alias("_t")))
    rows = left.join(users, "user_id").join(per_user_totals(events, per_user), "user_id", "left")
    aw = F.col("_a") * left_weight()
    agg = (rows.groupBy("country", "latitude", "longitude")
           .agg(F.count("user_id").alias("user_count"),
                div(F.sum(aw * F.col("_ls")), F.sum(aw * F.col("_lc"))).alias("_ret"),
                F.coalesce(F.sum(F.col("_a") * F.col("_c") * F.col("ev_fee")), F.lit(0)).alias("_rev"),
                F.sum(aw * F.col("_t")).alias("trial_abuse_users"))
           .filter(F.col("user_count") >= params.cluster_min_users)
           .withColumn("_rpu", div("_rev", "user_count")))
    rpu, ret = F.col("_rpu"), F.col("_ret")
    market = first_match([
        ((rpu > params.cluster_high_revenue) & (ret > params.cluster_high_retention), F.lit(MARKET_HIGH_VALUE)),
        ((rpu > params.cluster_medium_revenue) | (ret > params.cluster_medium_retention), F.lit(MARKET_MEDIUM_VALUE)),
        (div("trial_abuse_users", "user_count") > params.cluster_risk_share, F.lit(MARKET_HIGH_RISK)),
    ], F.lit(MARKET_STANDARD))
    return agg.select(
        "country", "latitude", "longitude", "user_count",
        rnd(ret, 1).alias("avg_retention_days"),
        rnd(rpu, 2).alias("revenue_per_user"),
        "trial_abuse_users",
        rnd(pct("trial_abuse_users", "user_count"), 2).alias("abuse_rate"),
        market.alias("market_classification"),
    ).orderBy(F.col("revenue_per_user").desc_nulls_last())


def timezone_region(longitude) -> F.Column:
    lon = F.col(longitude) if isinstance(longitude, str) else longitude
    return first_match([(lon.between(lo, hi), F.lit(label)) for lo, hi, label in TIMEZONE_BANDS],
                       F.lit(TIMEZONE_UNKNOWN))


def timezone_usage(ncc: DataFrame, events: DataFrame, params: Params = DEFAULT,
                   per_user: DataFrame | None = None) -> DataFrame:
    """Usage by 60-degree longitude band (Unknown bands dropped)."""
    left = rows_per(ncc, ["country", "user_id", "longitude"], "_a")
    rows = join_user_events(left, per_user_totals(events, per_user))
    per_person = rows.select(
        "user_id",
        timezone_region("longitude").alias("timezone_region"),
        (F.col("_a") * F.coalesce(F.col("ev_ids"), F.lit(0))).alias("_events"),
        (F.col("_a") * F.col("ev_fee")).alias("_rev"),
    ).filter(F.col("timezone_region") != TIMEZONE_UNKNOWN)
    agg = per_person.groupBy("timezone_region").agg(
        F.countDistinct("user_id").alias("users"),
        F.sum("_events").alias("total_events"),
        F.sum("_rev").alias("_rev_sum"),
        F.count("_rev").alias("_rev_n"),
        F.avg("_events").alias("_avg_events"))
    return agg.select(
        "timezone_region", "users", "total_events",
        rnd("_rev_sum", 2).alias("total_revenue"),
        rnd("_avg_events", 1).alias("avg_events_per_user"),
        rnd(div("_rev_sum", "_rev_n"), 2).alias("avg_revenue_per_user"),
    ).orderBy(F.col("total_revenue").desc_nulls_last())
