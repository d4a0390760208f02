"""More hand-computed edge cases, one or two per report."""

import datetime as dt

from conftest import D, T, accounts, events, geography

from cohortlens.operators import abuse, geography as geo, kpis, platform, retention, rfm, sessions
from cohortlens.params import Params

P = Params()  # as_of 2023-04-01
G1 = [("1", "Alpha", 10.0, 30.0)]


def by(df, key):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- platform

def test_daily_trends_and_overlapping_platform_shares(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5, 1), fee=1),
                       dict(user_id=2, platform="web", datetime=T(2023, 1, 5, 2), fee=2),
                       dict(user_id=None, platform="web", datetime=T(2023, 1, 5, 3), fee=4),
                       dict(user_id=1, platform="ios", datetime=T(2023, 1, 5, 4), fee=8)])
    daily = {(r.date, r.platform): r for r in platform.daily_platform_trends(e).collect()}
    web = daily[(D(2023, 1, 5), "web")]
    assert (web.daily_active_users, web.daily_revenue) == (2, 7.0)
    perf = by(platform.platform_performance(e), "platform")
    # users are counted per platform, so user 1 appears in both shares
    assert (perf["web"].users, perf["ios"].users) == (2, 1)
    assert (perf["web"].user_percentage, perf["ios"].user_percentage) == (66.67, 33.33)
    assert perf["web"].sessions_per_user == 1.5


# ---------------------------------------------------------------- retention / abuse

def test_platform_retention_needs_all_three_fields(spark):
    u = accounts(spark, [dict(platform="web", created_date=D(2023, 1, 1), last_login=D(2023, 1, 31)),
                         dict(platform="web", created_date=D(2023, 1, 1), last_login=D(2023, 1, 10)),
                         dict(platform="web", created_date=D(2023, 1, 1), last_login=None),
                         dict(platform=None, created_date=D(2023, 1, 1), last_login=D(2023, 3, 1))])
    r = retention.platform_retention(u, P).collect()
    assert [(x.platform, x.total_users, x.retained_7d, x.retained_30d, x.retention_30d_pct) for x in r] == \
        [("web", 2, 2, 1, 50.0)]


def test_suspension_rate_counts_accounts_over_people(spark):
    short = dict(user_id=7, created_date=D(2023, 3, 1), last_login=D(2023, 3, 2), mp_country_code="1")
    u = accounts(spark, [short, short, short])
    r = abuse.trial_suspension_by_country(u, geography(spark, G1), P.with_(min_country_users=1)).collect()[0]
    assert (r.total_users, r.early_suspensions, r.early_suspension_rate) == (1, 3, 300.0)


def test_fraud_by_month_skips_unknown_creation(spark):
    u = accounts(spark, [dict(created_date=D(2023, 2, 1), last_login=D(2023, 2, 2)),
                         dict(created_date=D(2023, 2, 10), last_login=D(2023, 3, 30)),
                         dict(created_date=None, last_login=D(2023, 3, 30))])
    r = abuse.fraud_by_month(u, P).collect()
    assert [(x.year, x.month, x.total_registrations, x.trial_abuse_cases, x.abuse_rate) for x in r] == \
        [(2023, 2, 2, 1, 50.0)]


# ---------------------------------------------------------------- geography

def _world(spark):
    g = geography(spark, [("1", "Alpha", 10.0, 30.0), ("2", "Beta", -5.0, -100.0), ("3", "Gamma", 0.0, 150.0)])
    u = accounts(spark, [dict(user_id=1, mp_country_code="1", created_date=D(2023, 1, 1), last_login=D(2023, 1, 11)),
                         dict(user_id=1, mp_country_code="1", created_date=D(2023, 1, 1), last_login=D(2023, 1, 21)),
                         dict(user_id=2, mp_country_code="2", created_date=D(2023, 1, 1), last_login=D(2023, 1, 2)),
                         dict(user_id=3, mp_country_code="3", created_date=D(2023, 1, 1), last_login=D(2023, 1, 2)),
                         dict(user_id=4, mp_country_code="3", created_date=D(2023, 1, 1), last_login=D(2023, 1, 2))])
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2022, 1, 5), fee=10, volume=1.0),
                       dict(user_id=1, platform="web", datetime=T(2023, 1, 5), fee=20, volume=2.0),
                       dict(user_id=1, platform="web", datetime=T(2023, 2, 5), fee=30, volume=3.0),
                       dict(user_id=2, platform="web", datetime=T(2023, 1, 5), fee=5, volume=1.0)])
    return u, e, g


def test_top_countries_share_of_all_and_name_ties(spark):
    u, _, g = _world(spark)
    ncc = geo.number_customer_country(u, g, P)
    got = [(r.country, r.number_customers, r.percentage) for r in geo.top_countries(ncc, P.with_(top_countries_k=2)).collect()]
    assert got == [("Alpha", 2, 40.0), ("Gamma", 2, 40.0)]


def test_country_revenue_fans_out_per_account(spark):
    u, e, g = _world(spark)
    ncc = geo.number_customer_country(u, g, P)
    r = by(geo.country_revenue(ncc, e, P.with_(min_revenue_country_users=1)), "country")
    # user 1 has two accounts in Alpha and three events: every event counts twice
    assert (r["Alpha"].total_users, r["Alpha"].active_users, r["Alpha"].total_revenue) == (1, 1, 120.0)
    assert r["Alpha"].events_per_active_user == 6.0
    assert (r["Gamma"].active_users, r["Gamma"].activation_rate, r["Gamma"].revenue_per_active_user) == (0, 0.0, None)


def test_seasonal_months_fold_years_together(spark):
    u, e, g = _world(spark)
    ncc = geo.number_customer_country(u, g, P)
    got = {(r.country, r.month): (r.active_users, r.total_events, r.total_revenue)
           for r in geo.seasonal_by_top_countries(ncc, e, P.with_(seasonal_top_countries_k=3)).collect()}
    # January 2022 and January 2023 share month 1; user 1's two accounts double everything
    assert got[("Alpha", 1)] == (1, 4, 60.0)
    assert got[("Alpha", 2)] == (1, 2, 60.0)
    assert got[("Beta", 1)] == (1, 1, 5.0)


def test_country_engagement_and_clusters(spark):
    u, e, g = _world(spark)
    ncc = geo.number_customer_country(u, g, P)
    eng = by(geo.country_engagement(ncc, u, e, P.with_(min_engagement_country_users=1)), "country")
    # Alpha: user 1 with accounts of life 10 and 20 (two groups), each seeing 2 x 3 events
    assert (eng["Alpha"].total_users, eng["Alpha"].avg_user_lifespan_days, eng["Alpha"].avg_events_per_user) == (2, 15.0, 6.0)
    assert eng["Gamma"].engaged_users == 0 and eng["Gamma"].avg_revenue_per_user is None
    cl = by(geo.country_clusters(ncc, u, e, P.with_(cluster_min_users=1)), "country")
    # Alpha: joined rows = 2 placed x 2 accounts x 3 events; life 10/20 -> mean 15, revenue 4 x 60 per 1 person
    assert (cl["Alpha"].avg_retention_days, cl["Alpha"].revenue_per_user, cl["Alpha"].trial_abuse_users) == (15.0, 240.0, 0)
    # revenue > 5 but retention 15 is not > 30: medium; Gamma is all trial-length accounts: high risk
    assert cl["Alpha"].market_classification == "Medium Value" and cl["Gamma"].market_classification == "High Risk"


# ---------------------------------------------------------------- sessions

def _bursty(spark):
    rows = []
    for d in (5, 6):  # user 1: three events inside six hours on two days
        rows += [dict(user_id=1, platform="web", datetime=T(2023, 1, d, 1, m)) for m in (0, 10, 20)]
    rows += [dict(user_id=2, platform="ios", datetime=T(2023, 1, 5, h)) for h in (0, 7, 13, 19)]
    return events(spark, rows)


def test_session_reports(spark):
    e = _bursty(spark)
    cmp = sessions.session_compare(e, P).collect()
    assert [(r.user_id, r.original_events, r.updated_events, r.events_reduced, r.reduction_percentage)
            for r in cmp] == [(1, 3, 1, 2, 66.67), (1, 3, 1, 2, 66.67)]
    plat = by(sessions.session_platform_impact(e, P), "platform")
    assert set(plat) == {"web"} and plat["web"].platform_reduction_pct == 66.67
    daily = by(sessions.session_daily_impact(e, P), "date")
    assert (daily[D(2023, 1, 5)].daily_original_events, daily[D(2023, 1, 5)].daily_updated_events) == (7, 5)
    assert sessions.session_user_impact(e, P).count() == 0  # nobody reaches 10 original events
    users = sessions.session_user_impact(e, P.with_(session_user_min_events=4)).collect()
    assert [(r.user_category, r.user_count, r.avg_original_events) for r in users] == \
        [("Light Users (10-19 events)", 2, 5.0)]


# ---------------------------------------------------------------- RFM reports

def test_segment_reports_weight_by_accounts(spark):
    seg = spark.createDataFrame(
        [(1, D(2023, 1, 1), 5, 2.0, 10.0, 1, 3, 3, "133", "At-risk Customer"),
         (2, D(2023, 1, 1), 50, 1.0, 4.0, 4, 1, 1, "411", "Walk-in Guests")],
        "user_id long, created_date date, recency long, frequency double, monetary double, "
        "R long, F long, M long, rfm_score string, customer_segment string")
    u = accounts(spark, [dict(user_id=1, mp_country_code="1", platform="web")] * 3
                 + [dict(user_id=2, mp_country_code="1", platform="ios")])
    country = by(rfm.segment_by_country(seg, u, geography(spark, G1), P.with_(rfm_country_min_customers=1)),
                 "customer_segment")
    assert (country["At-risk Customer"].customer_count, country["At-risk Customer"].total_revenue) == (3, 30.0)
    plat = {(r.platform, r.customer_segment): r.customer_count for r in rfm.segment_by_platform(seg, u).collect()}
    assert plat == {("web", "At-risk Customer"): 3, ("ios", "Walk-in Guests"): 1}
    life = by(rfm.segment_lifecycle(seg, P), "customer_segment")
    assert (life["At-risk Customer"].avg_customer_age_days, life["At-risk Customer"].estimated_monthly_clv) == (90.0, 20.0)
    dist = rfm.rfm_score_distribution(seg, P.with_(rfm_distribution_k=1)).collect()
    assert [(r.rfm_score, r["count"], r.percentage) for r in dist] == [("133", 1, 50.0)]


# ---------------------------------------------------------------- KPIs

def test_platform_kpis_event_weighted_lifetime(spark):
    u = accounts(spark, [dict(user_id=1, platform="web", created_date=D(2023, 1, 1), last_login=D(2023, 1, 11)),
                         dict(user_id=1, platform="web", created_date=D(2023, 1, 1), last_login=D(2023, 1, 21)),
                         dict(user_id=2, platform="web", created_date=D(2023, 1, 1), last_login=D(2023, 2, 10))])
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 2), fee=1)] * 3)
    r = kpis.platform_kpis(u, e, P).collect()[0]
    # lives 10 and 20 each seen by 3 events, 40 seen once: 130 / 7
    assert (r.total_users, r.active_users, r.total_events, r.avg_user_lifetime_days) == (2, 1, 6, 18.6)
    os_r = kpis.os_performance(accounts(spark, [dict(user_id=i, os="ios") for i in range(10)]), e, P).collect()
    assert [(x.os, x.total_users, x.active_users) for x in os_r] == [("ios", 10, 1)]


def test_weekly_trends_start_monday_and_compare_weeks(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 1), fee=1),    # Sunday
                       dict(user_id=2, platform="web", datetime=T(2023, 1, 2), fee=1),    # Monday
                       dict(user_id=3, platform="web", datetime=T(2023, 1, 8), fee=1)])   # Sunday
    got = [(r.week_start, r.weekly_active_users, r.prev_week_users, r.user_growth_rate)
           for r in kpis.weekly_trends(e).collect()]
    assert got == [(D(2022, 12, 26), 1, None, None), (D(2023, 1, 2), 2, 1, 100.0)]


def test_peak_hours_rank_ties(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5, h)) for h in (1, 1, 2, 2, 3)])
    got = {r.hour_of_day: r.usage_rank for r in kpis.peak_hours(e).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_acquisition_and_cohort_revenue(spark):
    u = accounts(spark, [dict(user_id=1, platform="web", created_date=D(2023, 1, 3)),
                         dict(user_id=2, platform="ios", created_date=D(2023, 1, 20)),
                         dict(user_id=3, platform="ios", created_date=D(2023, 1, 28)),
                         dict(user_id=1, platform="web", created_date=D(2023, 2, 1))])
    acq = by(kpis.acquisition_by_month(u), "acquisition_month")
    jan = acq[D(2023, 1, 1)]
    assert (jan.new_users, jan.web_acquisitions, jan.ios_acquisition_rate) == (3, 1, 66.7)
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5), fee=10),
                       dict(user_id=2, platform="ios", datetime=T(2023, 1, 6), fee=0)])
    coh = by(kpis.cohort_revenue(u, e), "cohort_month")
    jan = coh[D(2023, 1, 1)]
    assert (jan.cohort_size, jan.paying_users, jan.cohort_total_revenue, jan.avg_revenue_per_paying_user) == \
        (3, 1, 10.0, 10.0)
    assert coh[D(2023, 2, 1)].paying_users == 1  # the same person, counted in each creation month
