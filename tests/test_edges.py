"""Hand-written edge fixtures with exact expected values (FIXTURES.md section A)."""

from conftest import D, T, accounts, events, geography, rows

from cohortlens.operators import abuse, geography as geo, kpis, platform, retention, rfm, sessions
from pyspark.sql import functions as F

from cohortlens.functions.columns import rnd
from cohortlens.params import Params

P = Params()  # as_of 2023-04-01


# ---------------------------------------------------------------- sessions

def test_session_bucket_edges(spark):
    times = [T(2023, 1, 5, 0, 0), T(2023, 1, 5, 5, 59), T(2023, 1, 5, 6, 0), T(2023, 1, 5, 12, 0),
             T(2023, 1, 5, 12, 1), T(2023, 1, 5, 18, 0), T(2023, 1, 5, 18, 1)]
    e = events(spark, [dict(user_id=1, platform="web", datetime=t, fee=1.25, volume=2.0) for t in times])
    b = sessions.session_buckets(e, P)
    got = sorted(rows(b, "_grp", "_events", "volume", "fee"))
    assert [g[:2] for g in got] == [(1, 2), (2, 2), (3, 2), (4, 1)]
    assert sum(g[2] for g in got) == 14.0 and float(sum(g[3] for g in got)) == 8.75
    eu = sessions.events_updated(e, P)
    assert sorted(r.id for r in eu.collect()) == [1, 2, 3, 4]
    first = {r.id: r.datetime for r in eu.collect()}
    assert first[1] == times[0] and first[4] == times[6]


def test_null_datetime_goes_to_last_bucket(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5, 1, 0)),
                       dict(user_id=1, platform="web", datetime=None, date=D(2023, 1, 5))])
    assert sorted(rows(sessions.session_buckets(e, P), "_grp")) == [(1,), (4,)]


def test_session_day_is_the_day_of_its_time(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5, 23, 0), date=D(2023, 1, 6), volume=1.0, fee=1),
                       dict(user_id=1, platform="web", datetime=T(2023, 1, 5, 23, 30), date=D(2023, 1, 6), volume=2.0, fee=1),
                       dict(user_id=2, platform="web", datetime=None, date=D(2023, 1, 6), volume=4.0, fee=1)])
    assert sorted(rows(sessions.sessions(e, P), "user_id", "date", "volume"), key=str) == [(1, D(2023, 1, 5), 3.0), (2, None, 4.0)]
    stats = sessions.session_key_stats(e, P)
    assert rows(stats, "date", "original_events", "updated_events") == [(D(2023, 1, 5), 2, 1)]


def test_rounding_of_very_large_totals(spark):
    got = spark.range(1).select(rnd(F.lit(1.2345e17), 2).alias("a"), rnd(F.lit(-1.2345e17), 2).alias("b"),
                                rnd(F.lit(2.345), 2).alias("c"), rnd(F.lit(None).cast("double"), 2).alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == (1.2345e17, -1.2345e17, 2.35, None)


def test_null_user_events_dropped_by_sessions_kept_in_engagement(spark):
    e = events(spark, [dict(user_id=None, platform="web", datetime=T(2023, 1, 5, 1)),
                       dict(user_id=None, platform="web", datetime=T(2023, 1, 6, 1)),
                       dict(user_id=7, platform="web", datetime=T(2023, 1, 5, 2))])
    assert rows(sessions.events_updated(e, P), "user_id") == [(7,)]
    seg = kpis.engagement_segments(e, P).collect()
    assert sum(r.user_count for r in seg) == 2  # user 7 and the no-user group


def test_gaming_assessment_classes(spark):
    evs = []
    base = T(2023, 1, 5, 1, 0)
    import datetime as dt
    for i in range(51):   # 51 events within 59 minutes
        evs.append(dict(user_id=1, platform="web", datetime=base + dt.timedelta(seconds=i * 69)))
    for i in range(31):   # 31 events spanning 2 hours, 2 distinct hours
        evs.append(dict(user_id=2, platform="web", datetime=base + dt.timedelta(minutes=i * 3)))
    for i in range(21):   # 21 events within 29 minutes
        evs.append(dict(user_id=3, platform="web", datetime=base + dt.timedelta(seconds=i * 80)))
    for i in range(15):   # 15 events spread over the day
        evs.append(dict(user_id=4, platform="web", datetime=base + dt.timedelta(hours=i)))
    got = dict(rows(sessions.gaming_patterns(events(spark, evs), P), "user_id", "gaming_assessment"))
    assert got == {1: "Likely Gaming", 2: "Possible Gaming", 3: "Suspicious Pattern", 4: "Normal Usage"}


# ---------------------------------------------------------------- platform / KPIs

def test_platform_use_other_platform_date(spark):
    e = events(spark, [dict(user_id=1, platform="tv", datetime=T(2023, 1, 5, 1)),
                       dict(user_id=1, platform="web", datetime=T(2023, 1, 6, 1))])
    got = dict((r.date, (r.web, r.android, r.ios)) for r in platform.platform_use(e).collect())
    assert got == {D(2023, 1, 5): (0, 0, 0), D(2023, 1, 6): (1, 0, 0)}


def test_multi_platform_user_counts_twice_in_total_dau(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5, 1)),
                       dict(user_id=1, platform="ios", datetime=T(2023, 1, 5, 2))])
    r = kpis.dau_by_platform(e).collect()[0]
    assert (r.web_dau, r.ios_dau, r.android_dau, r.total_dau) == (1, 1, 0, 2)


def test_churn_edges(spark):
    as_of = D(2023, 4, 1)
    import datetime as dt
    days = [7, 8, 30, 31, 90, 91]
    u = accounts(spark, [dict(user_id=i, created_date=D(2022, 1, 1), last_login=as_of - dt.timedelta(days=d),
                              platform="web") for i, d in enumerate(days)]
                 + [dict(user_id=99, created_date=None, last_login=None, platform="web")])
    e = events(spark, [dict(user_id=0, platform="web", datetime=T(2023, 1, 1))])
    got = {r.churn_status: r.user_count for r in kpis.churn_status(u, e, P).collect()}
    assert got == {"Active": 1, "At Risk": 2, "Dormant": 2, "Churned": 2}


def test_revenue_edges(spark):
    fees = [0, 0.01, 10, 50, 100]
    u = accounts(spark, [dict(user_id=i, created_date=D(2023, 1, 1), platform="web") for i in range(len(fees))])
    e = events(spark, [dict(user_id=i, platform="web", datetime=T(2023, 1, 2), fee=f) for i, f in enumerate(fees)])
    got = {r.clv_segment: r.user_count for r in kpis.clv_segments(u, e, P).collect()}
    assert got == {"No Revenue": 1, "Minimal Value (0-9)": 1, "Low Value (10-49)": 1,
                   "Medium Value (50-99)": 1, "High Value (100+)": 1}


def test_engagement_span_whole_days(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5, 23)),
                       dict(user_id=1, platform="web", datetime=T(2023, 1, 6, 22))])
    r = kpis.engagement_segments(e, P).collect()[0]
    assert (r.avg_lifetime_days, r.avg_active_days, r.avg_engagement_ratio) == (1.0, 2.0, 2.0)


def test_growth_after_zero_revenue_month_is_null(spark):
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 5), fee=0),
                       dict(user_id=1, platform="web", datetime=T(2023, 2, 5), fee=5)])
    got = {(r.year, r.month): r.revenue_growth_rate for r in kpis.mau_growth(e).collect()}
    assert got == {(2023, 1): None, (2023, 2): None}


def test_fan_out_triples_fee(spark):
    u = accounts(spark, [dict(user_id=1, created_date=D(2023, 1, 1), platform="web", feature="f")] * 3)
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 1, 2), fee=2.5)] * 2)
    r = kpis.revenue_metrics(u, e).collect()[0]
    assert (r.total_transactions, r.total_revenue, r.median_transaction_value) == (6, 15.0, 2.5)
    f = kpis.feature_usage(u, e).collect()[0]
    assert (f.events_from_feature, f.feature_revenue) == (6, 15.0)


# ---------------------------------------------------------------- abuse

def test_repeat_accounts_threshold_and_null_user(spark):
    short = dict(created_date=D(2023, 3, 1), last_login=D(2023, 3, 2), os="ios", mp_country_code="1")
    u = accounts(spark, [dict(user_id=1, **short)] * 6 + [dict(user_id=2, **short)] * 5
                 + [dict(user_id=None, **short)] * 6)
    g = geography(spark, [("1", "Indonesia", 0.0, 100.0)])
    ranked = abuse.abuse_by_country(u, g, P).collect()
    assert [(r.country, r.cheater_count, r.fraud_rank) for r in ranked] == [("Indonesia", 1, 1)]
    users = sorted(rows(abuse.serious_cheaters(u, g, P), "user_id"), key=str)
    assert users == [(1,), (None,)]


def test_life_three_vs_four_days(spark):
    u = accounts(spark, [dict(user_id=1, created_date=D(2023, 3, 1), last_login=D(2023, 3, 4), platform="web", os="ios"),
                         dict(user_id=2, created_date=D(2023, 3, 1), last_login=D(2023, 3, 5), platform="web", os="ios")])
    r = abuse.platform_fraud(u, P).collect()[0]
    assert (r.total_accounts, r.suspicious_accounts, r.fraud_rate) == (2, 1, 50.0)


# ---------------------------------------------------------------- retention

def test_retention_text_and_censoring(spark):
    c = D(2023, 1, 1)
    u = accounts(spark, [
        dict(user_id=1, created_date=c, last_login=D(2023, 1, 8)),    # life 7: gone at interval 1
        dict(user_id=2, created_date=c, last_login=D(2023, 1, 9)),    # life 8: kept at interval 1
        dict(user_id=3, created_date=c, last_login=None),             # open until as_of
        dict(user_id=4, created_date=None, last_login=D(2023, 1, 9)),
    ])
    got = {r.created_date: r for r in retention.retention_intervals(u, P).collect()}
    assert got[c].day1_retention == "66.67%" and got[c].day0_retention == 1.0
    assert got[None].day1_retention == "100%" and got[None].day7_retention == "100%"
    monthly = retention.cohort_retention_monthly(u, P).collect()
    assert [(m.year, m.month, m.cohort_size, m.retention_7d_pct) for m in monthly] == [(2023, 1, 3, 66.67)]


# ---------------------------------------------------------------- geography

def test_longitude_bands(spark):
    lons = [-180, -120, -60, 0, 60, 120, 180, None, 181]
    g = geography(spark, [(str(i), f"C{i}", 0.0, None if x is None else float(x)) for i, x in enumerate(lons)])
    u = accounts(spark, [dict(user_id=i, mp_country_code=str(i)) for i in range(len(lons))])
    e = events(spark, [dict(user_id=i, platform="web", datetime=T(2023, 1, 1)) for i in range(len(lons))])
    ncc = geo.number_customer_country(u, g, P)
    got = {r.timezone_region: r.users for r in geo.timezone_usage(ncc, e, P).collect()}
    assert got == {"UTC-8 to UTC-11": 2, "UTC-4 to UTC-8": 1, "UTC-0 to UTC-4": 1, "UTC+0 to UTC+4": 1,
                   "UTC+4 to UTC+8": 1, "UTC+8 to UTC+12": 1}


def test_platform_share_after_having(spark):
    per_platform = {"web": 6, "android": 5, "ios": 4}
    accts = []
    uid = 0
    for p, n in per_platform.items():
        for _ in range(n):
            accts.append(dict(user_id=uid, platform=p, mp_country_code="1"))
            uid += 1
    u = accounts(spark, accts)
    g = geography(spark, [("1", "X", 0.0, 0.0)])
    got = {r.platform: r.platform_share for r in geo.country_platform_share(geo.number_customer_country(u, g, P), u, P).collect()}
    assert got == {"web": 54.55, "android": 45.45}


# ---------------------------------------------------------------- RFM

def _rfm_inputs(spark, n, created=D(2023, 1, 15)):
    import datetime as dt
    u = accounts(spark, [dict(user_id=i, created_date=created) for i in range(n)])
    e = events(spark, [dict(user_id=i, platform="web", datetime=T(2023, 3, 1) + dt.timedelta(days=i), fee=10 + i)
                       for i in range(n) for _ in range(1 + i % 3)])
    return u, e


def test_month_boundaries_and_created_in_as_of_month(spark):
    u = accounts(spark, [dict(user_id=1, created_date=D(2023, 1, 31)), dict(user_id=2, created_date=D(2023, 4, 1))])
    e = events(spark, [dict(user_id=1, platform="web", datetime=T(2023, 3, 30), fee=30),
                       dict(user_id=2, platform="web", datetime=T(2023, 3, 30), fee=30)])
    base = {r.user_id: r for r in rfm.rfm_base(sessions.sessions(e, P), u, P).collect()}
    assert base[1].frequency == 1 / 3 and base[1].monetary == 10.0
    assert base[2].frequency is None and base[2].monetary is None
    scores = {r.user_id: (r.F, r.M) for r in rfm.rfm_scores(rfm.rfm_base(sessions.sessions(e, P), u, P), P).collect()}
    assert scores[2] == (4, 4)


def test_rfm_recency_inversion_and_segments(spark):
    u, e = _rfm_inputs(spark, 8)
    seg = rfm.rfm_segments(rfm.rfm_scores(rfm.rfm_base(sessions.sessions(e, P), u, P), P))
    got = seg.collect()
    assert {r.R for r in got} <= {1, 4}
    assert "Other" not in {r.customer_segment for r in got}
    trans = rfm.segment_transitions(seg).collect()
    counts = {r.customer_segment: 0 for r in got}
    for r in got:
        counts[r.customer_segment] += 1
    assert [t.target_segment for t in trans] == ["VIP", "Regular Customers"]
    assert trans[1].from_regular == counts.get("Potential Customers", 0)


def test_rfm_small_sizes_use_rounded_positions(spark):
    for n in (1, 2, 6):
        u, e = _rfm_inputs(spark, n)
        scores = rfm.rfm_scores(rfm.rfm_base(sessions.sessions(e, P), u, P), P).collect()
        assert len(scores) == n
        if n == 1:  # position round(0.25) = 0 -> NULL threshold -> ELSE 4
            assert (scores[0].R, scores[0].F, scores[0].M) == (4, 4, 4)


def test_rfm_threshold_positions_round_half_away(spark):
    for n, positions in ((1, (0, 1, 1)), (2, (1, 1, 2)), (6, (2, 3, 5))):
        # metric value = its own position, so the threshold equals the position taken
        base = spark.createDataFrame(
            [(i, None, i, float(i), float(i), i, i, i) for i in range(1, n + 1)],
            "user_id long, created_date date, recency long, frequency double, monetary double, "
            "recency_rn long, frequency_rn long, monetary_rn long")
        t = rfm.rfm_thresholds(base, P)
        want = [p if p >= 1 else None for p in positions]
        assert t["recency"] == want and t["frequency"] == [None if w is None else float(w) for w in want]


def test_rfm_corrected_mode_uses_all_recency_scores(spark):
    u, e = _rfm_inputs(spark, 12)
    p = P.with_(recency_mode="corrected")
    scores = rfm.rfm_scores(rfm.rfm_base(sessions.sessions(e, p), u, p), p).collect()
    assert {r.R for r in scores} == {1, 2, 3, 4}
