"""Trial-abuse reports: repeated short-lived accounts per person.

All groupings are on account attributes, so each report is one partial +
final aggregation; the country dimension joins after the aggregation
(or as a broadcast behind a size check), never shuffling the accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_lit, first_match, life_days, pct, rnd
from ..functions.labels import RISK_EXTREME, RISK_HIGH, RISK_LOW, RISK_MEDIUM
from ..params import DEFAULT, Params
from ..plans.broadcast import dimension

GROUP = ["user_id", "mp_country_code", "os"]


def _countries(geography: DataFrame, params: Params) -> DataFrame:
    return dimension(geography.select("code", "country"), params.dimension_max_rows)


def abuse_by_country(user_info: DataFrame, geography: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Countries ranked by people with more than ``repeat_threshold`` trial-length accounts."""
    used = F.coalesce(life_days(params.as_of),
                      F.datediff(date_lit(params.abuse_fallback_date), F.col("created_date")))
    repeat = (user_info.filter((used <= params.trial_days) & F.col("user_id").isNotNull())
              .groupBy(*GROUP).agg(F.count("id").alias("_n"))
              .filter(F.col("_n") > params.repeat_threshold))
    g = _countries(geography, params)
    summary = (repeat.join(g, repeat["mp_country_code"] == g["code"])
               .groupBy("country").agg(F.count(F.lit(1)).alias("cheater_count")))
    by_count = Window.orderBy(F.col("cheater_count").desc())  # one row per country
    return summary.select("country", "cheater_count",
                          F.rank().over(by_count).cast("long").alias("fraud_rank")
                          ).orderBy(F.col("cheater_count").desc(), "country")


def serious_cheaters(user_info: DataFrame, geography: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per (person, country, os) with many trial-length accounts.  (CTAS ``serious_cheaters``)"""
    used = life_days(params.as_of)
    patterns = (user_info.filter(used <= params.trial_days)
                .groupBy(*GROUP)
                .agg(F.count(F.lit(1)).alias("abuse_count"),
                     F.min("created_date").alias("first_abuse"),
                     F.max("created_date").alias("last_abuse"),
                     F.avg(used).alias("avg_days_used"))
                .filter(F.col("abuse_count") > params.repeat_threshold))
    g = _countries(geography, params)
    return patterns.join(g, patterns["mp_country_code"] == g["code"]).select(
        *GROUP, "abuse_count", "first_abuse", "last_abuse", "avg_days_used", "country",
        F.datediff("last_abuse", "first_abuse").cast("long").alias("abuse_period_days"))


def trial_suspension_by_country(user_info: DataFrame, geography: DataFrame,
                                params: Params = DEFAULT) -> DataFrame:
    """Distinct people vs trial-length accounts per country (rate may exceed 100)."""
    g = _countries(geography, params)
    used = life_days(params.as_of)
    agg = (user_info.join(g, user_info["mp_country_code"] == g["code"])
           .groupBy("country")
           .agg(F.countDistinct("user_id").alias("total_users"),
                F.count(F.when(used <= params.trial_days, F.lit(1))).alias("early_suspensions"))
           .filter(F.col("total_users") >= params.min_country_users))
    return agg.select("country", "total_users", "early_suspensions",
                      rnd(pct("early_suspensions", "total_users"), 2).alias("early_suspension_rate")
                      ).orderBy(F.col("early_suspension_rate").desc_nulls_last())


def _abuse_rate_by(user_info: DataFrame, keys: list, total: str, flagged: str, rate: str,
                   params: Params) -> DataFrame:
    used = life_days(params.as_of)
    agg = user_info.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total),
        F.count(F.when(used <= params.trial_days, F.lit(1))).alias(flagged))
    return agg.withColumn(rate, rnd(pct(flagged, total), 2))


def platform_fraud(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    known = user_info.filter(F.col("platform").isNotNull() & F.col("os").isNotNull())
    return _abuse_rate_by(known, ["platform", "os"], "total_accounts", "suspicious_accounts", "fraud_rate",
                          params).orderBy(F.col("fraud_rate").desc_nulls_last())


def fraud_by_month(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    dated = user_info.filter(F.col("created_date").isNotNull())
    keys = [F.year("created_date").cast("long").alias("year"), F.month("created_date").cast("long").alias("month")]
    return _abuse_rate_by(dated, keys, "total_registrations", "trial_abuse_cases", "abuse_rate",
                          params).orderBy("year", "month")


def account_anomalies(user_info: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every (person, country, os) with more than one account, with a risk level."""
    stats = (user_info.groupBy(*GROUP)
             .agg(F.count(F.lit(1)).alias("account_count"),
                  F.min("created_date").alias("_first"),
                  F.max("created_date").alias("_latest"),
                  F.avg(life_days(params.as_of)).alias("_avg_days"))
             .filter(F.col("account_count") > 1))
    n, avg_days = F.col("account_count"), F.col("_avg_days")
    level = first_match([
        (n > params.anomaly_extreme, F.lit(RISK_EXTREME)),
        (n > params.anomaly_high, F.lit(RISK_HIGH)),
        ((n > params.anomaly_medium) & (avg_days < params.anomaly_medium_max_days), F.lit(RISK_MEDIUM)),
    ], F.lit(RISK_LOW))
    return stats.select(
        *GROUP, "account_count",
        F.datediff("_latest", "_first").cast("long").alias("account_span_days"),
        rnd(avg_days, 2).alias("avg_usage_days"),
        level.alias("fraud_risk_level"),
    ).orderBy(F.col("account_count").desc(), F.col("avg_usage_days").asc())
