"""Registry of every report and derived table of the suite.

Each entry is ``fn(d: Derived) -> DataFrame``.  ``Derived`` hands out the
base tables, the parameters and the derived tables
(``number_customer_country``, ``events_updated``, RFM tables): computed
on the fly for a stand-alone query, or read back from a warehouse when
the suite runs as a pipeline (``cohortlens.runner``), the way the
original scripts create their tables once and report from them.

``event_view`` names the event table the test wiring uses: ``"events"``
or ``"orders"`` (orders seen as events, a many-month series for the
monthly/weekly trend reports).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame

from .operators import abuse as ab
from .operators import activity as act
from .operators import changes as chg
from .operators import geography as geo
from .operators import kpis as kpi
from .operators import platform as pl
from .operators import retention as rt
from .operators import rfm
from .operators import sessions as ss
from .params import DEFAULT, Params
from .plans.fanout import events_per_user
from .sources.tables import Tables


@dataclass
class Derived:
    tables: Tables
    params: Params = DEFAULT
    materialized: dict[str, DataFrame] = field(default_factory=dict)

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.materialized:
            self.materialized[name] = build()
        return self.materialized[name]

    @property
    def ncc(self) -> DataFrame:
        t, p = self.tables, self.params
        return self._get("number_customer_country", lambda: geo.number_customer_country(t.user_info, t.geography, p))

    @property
    def events_updated(self) -> DataFrame | None:
        """Materialised table if there is one; reports otherwise derive what they need."""
        return self.materialized.get("events_updated")

    @property
    def per_user(self) -> DataFrame | None:
        """Materialised per-user event totals, shared by the account x event reports."""
        return self.materialized.get("user_event_totals")

    @property
    def session_stats(self) -> DataFrame | None:
        """Materialised per (user, platform, date) before/after session counts."""
        return self.materialized.get("session_key_stats")

    @property
    def rfm_base(self) -> DataFrame:
        t, p = self.tables, self.params
        # per-user totals need no global ids, so id-less sessions feed it when no table exists
        eu = self.events_updated
        return self._get("rfm_base", lambda: rfm.rfm_base(eu if eu is not None else ss.sessions(t.events, p),
                                                          t.user_info, p))

    @property
    def rfm_values(self) -> DataFrame:
        """The metrics without row numbers, on the fly."""
        t, p, eu = self.tables, self.params, self.events_updated
        return rfm.rfm_values(eu if eu is not None else ss.sessions(t.events, p), t.user_info, p)

    @property
    def rfm_scores(self) -> DataFrame:
        def build() -> DataFrame:
            written = "rfm_base" in self.materialized
            cut = None if written else rfm.threshold_row(self.rfm_values, self.params)     # not from numbered rows: fewer passes
            return rfm.rfm_scores(self.rfm_base, self.params, cut)
        return self._get("rfm_scores", build)

    @property
    def rfm_segments(self) -> DataFrame:
        """From written scores if there are any, else from the values alone: segments need no row numbers."""
        def build() -> DataFrame:
            scores = self.materialized.get("rfm_scores")
            if scores is None:
                scores = rfm.rfm_scores(self.rfm_values, self.params)
            return rfm.rfm_segments(scores)
        return self._get("rfm_segments", build)


@dataclass(frozen=True)
class Report:
    fn: Callable[[Derived], DataFrame]
    event_view: str = "events"
    needs: tuple[str, ...] = ()   # materialised tables it reads in a pipeline run


def _r(fn, view: str = "events", needs: tuple[str, ...] = ()) -> Report:
    return Report(fn, view, needs)


REPORTS: dict[str, Report] = {
    # platform usage
    "platform_use": _r(lambda d: pl.platform_use(d.tables.events)),
    "volume_use": _r(lambda d: pl.volume_use(d.tables.events)),
    "platform_comparison": _r(lambda d: pl.platform_comparison(d.tables.events)),
    "daily_platform_trends": _r(lambda d: pl.daily_platform_trends(d.tables.events)),
    "platform_performance": _r(lambda d: pl.platform_performance(d.tables.events)),
    # retention
    "retention_intervals": _r(lambda d: rt.retention_intervals(d.tables.user_info, d.params)),
    "cohort_retention_monthly": _r(lambda d: rt.cohort_retention_monthly(d.tables.user_info, d.params)),
    "platform_retention": _r(lambda d: rt.platform_retention(d.tables.user_info, d.params)),
    # trial abuse
    "abuse_by_country": _r(lambda d: ab.abuse_by_country(d.tables.user_info, d.tables.abuse_geography, d.params)),
    "serious_cheaters": _r(lambda d: ab.serious_cheaters(d.tables.user_info, d.tables.abuse_geography, d.params)),
    "trial_suspension_by_country": _r(
        lambda d: ab.trial_suspension_by_country(d.tables.user_info, d.tables.geography, d.params)),
    "platform_fraud": _r(lambda d: ab.platform_fraud(d.tables.user_info, d.params)),
    "fraud_by_month": _r(lambda d: ab.fraud_by_month(d.tables.user_info, d.params)),
    "account_anomalies": _r(lambda d: ab.account_anomalies(d.tables.user_info, d.params)),
    # geography
    "number_customer_country": _r(lambda d: d.ncc),
    "top_countries": _r(lambda d: geo.top_countries(d.ncc, d.params), needs=("number_customer_country",)),
    "country_revenue": _r(lambda d: geo.country_revenue(d.ncc, d.tables.events, d.params, d.per_user), needs=("number_customer_country", "user_event_totals")),
    "country_platform_share": _r(lambda d: geo.country_platform_share(d.ncc, d.tables.user_info, d.params), needs=("number_customer_country",)),
    "os_by_top_countries": _r(lambda d: geo.os_by_top_countries(d.ncc, d.tables.user_info, d.params), needs=("number_customer_country",)),
    "country_engagement": _r(lambda d: geo.country_engagement(d.ncc, d.tables.user_info, d.tables.events, d.params,
                                                              d.per_user), needs=("number_customer_country", "user_event_totals")),
    "seasonal_by_top_countries": _r(lambda d: geo.seasonal_by_top_countries(d.ncc, d.tables.events, d.params),
                                    "orders", needs=("number_customer_country",)),
    "country_clusters": _r(lambda d: geo.country_clusters(d.ncc, d.tables.user_info, d.tables.events, d.params,
                                                          d.per_user), needs=("number_customer_country", "user_event_totals")),
    "timezone_usage": _r(lambda d: geo.timezone_usage(d.ncc, d.tables.events, d.params, d.per_user), needs=("number_customer_country", "user_event_totals")),
    # anchored sessions
    "events_updated": _r(lambda d: d.events_updated if d.events_updated is not None
                         else ss.events_updated(d.tables.events, d.params)),
    "session_compare": _r(lambda d: ss.session_compare(d.tables.events, d.params, d.events_updated, d.session_stats), needs=("session_key_stats",)),
    "session_user_impact": _r(lambda d: ss.session_user_impact(d.tables.events, d.params, d.events_updated,
                                                                d.session_stats), needs=("session_key_stats",)),
    "session_platform_impact": _r(lambda d: ss.session_platform_impact(d.tables.events, d.params, d.events_updated,
                                                                        d.session_stats), needs=("session_key_stats",)),
    "session_daily_impact": _r(lambda d: ss.session_daily_impact(d.tables.events, d.params, d.events_updated,
                                                                  d.session_stats), needs=("session_key_stats",)),
    "gaming_patterns": _r(lambda d: ss.gaming_patterns(d.tables.events, d.params)),
    # RFM
    "rfm_base": _r(lambda d: d.rfm_base),
    "rfm_scores": _r(lambda d: d.rfm_scores),
    "rfm_segments": _r(lambda d: d.rfm_segments),
    "segment_summary": _r(lambda d: rfm.segment_summary(d.rfm_segments), needs=("rfm_segments",)),
    "rfm_score_distribution": _r(lambda d: rfm.rfm_score_distribution(d.rfm_segments, d.params), needs=("rfm_segments",)),
    "segment_by_country": _r(lambda d: rfm.segment_by_country(d.rfm_segments, d.tables.user_info,
                                                              d.tables.geography, d.params), needs=("rfm_segments",)),
    "segment_by_platform": _r(lambda d: rfm.segment_by_platform(d.rfm_segments, d.tables.user_info), needs=("rfm_segments",)),
    "segment_lifecycle": _r(lambda d: rfm.segment_lifecycle(d.rfm_segments, d.params), needs=("rfm_segments",)),
    "segment_transitions": _r(lambda d: rfm.segment_transitions(d.rfm_segments), needs=("rfm_segments",)),
    # business KPIs
    "dau_by_platform": _r(lambda d: kpi.dau_by_platform(d.tables.events)),
    "mau_growth": _r(lambda d: kpi.mau_growth(d.tables.events), "orders"),
    "acquisition_by_month": _r(lambda d: kpi.acquisition_by_month(d.tables.user_info)),
    "revenue_metrics": _r(lambda d: kpi.revenue_metrics(d.tables.user_info, d.tables.events, d.per_user), needs=("user_event_totals",)),
    "feature_usage": _r(lambda d: kpi.feature_usage(d.tables.user_info, d.tables.events, d.per_user), needs=("user_event_totals",)),
    "engagement_segments": _r(lambda d: kpi.engagement_segments(d.tables.events, d.params)),
    "churn_status": _r(lambda d: kpi.churn_status(d.tables.user_info, d.tables.events, d.params, d.per_user), needs=("user_event_totals",)),
    "platform_kpis": _r(lambda d: kpi.platform_kpis(d.tables.user_info, d.tables.events, d.params, d.per_user), needs=("user_event_totals",)),
    "weekly_trends": _r(lambda d: kpi.weekly_trends(d.tables.events), "orders"),
    "clv_segments": _r(lambda d: kpi.clv_segments(d.tables.user_info, d.tables.events, d.params, d.per_user), needs=("user_event_totals",)),
    "os_performance": _r(lambda d: kpi.os_performance(d.tables.user_info, d.tables.events, d.params, d.per_user), needs=("user_event_totals",)),
    "peak_hours": _r(lambda d: kpi.peak_hours(d.tables.events)),
    "cohort_revenue": _r(lambda d: kpi.cohort_revenue(d.tables.user_info, d.tables.events, d.per_user), needs=("user_event_totals",)),
}

# reports beyond the original statements
EXTENSIONS: dict[str, Report] = {
    "events_in_life": _r(lambda d: act.events_in_life(d.tables.user_info, d.tables.events, d.params)),
    "events_by_account": _r(lambda d: act.events_by_account(d.tables.user_info, d.tables.events, d.params)),
    "approx_active_users": _r(lambda d: act.approx_active_users(act.daily_user_sketches(d.tables.events, d.params), d.params)),
    "rolling_active_users": _r(lambda d: act.rolling_active_users(d.tables.events, d.params)),
    "account_cube": _r(lambda d: act.account_cube(d.tables.user_info, d.tables.geography, d.params)),
    "account_changes": _r(lambda d: chg.account_changes(d.tables.user_info, d.params)),
    "account_change_summary": _r(lambda d: chg.account_change_summary(d.tables.user_info, d.params)),
    "daily_usage_refreshed": _r(lambda d: chg.daily_usage_refreshed(d.tables.events, d.params)),
    "event_properties": _r(lambda d: chg.event_properties(d.tables.properties)),
}

# derived tables the original scripts materialise, in dependency order
DERIVED_TABLES = ["platform_use", "volume_use", "number_customer_country", "serious_cheaters",
                  "events_updated", "rfm_base", "rfm_scores", "rfm_segments"]

# shared intermediate tables a pipeline run materialises once (after
# ``events_updated``) so that no report re-reads the whole event table for them
SHARED_TABLES: dict[str, Callable[[Derived], DataFrame]] = {
    "user_event_totals": lambda d: events_per_user(d.tables.events),
    "session_key_stats": lambda d: ss.session_key_stats(d.tables.events, d.params, d.events_updated),
}
