"""Row numbers, order statistics, exact sums and the session plan without jobs
at build time: against brute force, on ties, nulls, heavy values and hot keys."""

import contextlib
import io
import math
import random
import statistics
from decimal import Decimal

import pytest
from conftest import D, T, accounts, events, geography
from pyspark.sql import functions as F

from cohortlens import Params, Tables, run_pipeline
from cohortlens.functions.columns import exact_avg, exact_sum
from cohortlens.operators import geography as geo
from cohortlens.operators import rfm, sessions
from cohortlens.plans.cells import numbered, order_statistics, weighted_percentile_cont
from cohortlens.plans.skew import attach_group_min
from cohortlens.runner import _run_dag
from cohortlens.sources.tables import EVENTS_SCHEMA, conform
from cohortlens.suite import REPORTS, Derived

P = Params()


def _values(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 1.5, 1.5, 1.5, float(rng.randrange(9)), rng.random() * 100, -rng.random()]), rng.choice([None, 7.0, rng.random()]))
            for i in range(n)]


@pytest.mark.parametrize("n,cells", [(0, 4), (1, 4), (37, 3), (600, 128), (600, 5)])
def test_numbered(spark, n, cells):
    rows = _values(n, n + cells)
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: (r.x, r.y) for r in numbered(df, {"x": (F.col("a"), True), "y": (-F.col("b"), False)}, ["id"], cells).collect()}
    by_a = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    by_b = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    want = {r[0]: [k + 1] for k, r in enumerate(by_a)}
    for k, r in enumerate(by_b):
        want[r[0]].append(k + 1)
    assert got == {i: tuple(v) for i, v in want.items()}


def test_numbered_splits_a_heavy_value(spark):
    """Nine rows in ten share a value; they are numbered in many cells, not one."""
    df = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.lit(5)).otherwise(F.col("id")).alias("v"), "id")
    got = numbered(df, {"rn": (F.col("v"), True)}, ["id"], 16)
    want = {r[1]: k + 1 for k, r in enumerate(sorted((5 if i % 10 else i, i) for i in range(2000)))}
    assert {r.id: r.rn for r in got.collect()} == want


@pytest.mark.parametrize("n,cells", [(0, 4), (1, 4), (2, 4), (41, 3), (500, 128)])
def test_order_statistics(spark, n, cells):
    rows = _values(n, 3 * n + cells)
    df = spark.createDataFrame(rows, "id long, a double, b double")
    qs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = order_statistics(df, {"a": (F.col("a"), True), "b": (F.col("b"), False)}, qs, cells).collect()
    assert len(got) == 1
    a = sorted((r[1] for r in rows), key=lambda v: (v is not None, v or 0))
    b = sorted((r[2] for r in rows), key=lambda v: (v is None, v or 0))
    for i, q in enumerate(qs):
        k = math.floor(q * n + 0.5)
        for name, vals in (("a", a), ("b", b)):
            assert got[0][f"{name}{i}"] == (vals[k - 1] if k else None)


def test_weighted_percentile_of_decimals(spark):
    rng = random.Random(2)
    vals = [(Decimal(rng.randrange(300)) / 100, rng.randrange(0, 5)) for _ in range(200)]
    df = spark.createDataFrame(vals, "v decimal(18,2), w long")
    expanded = sorted(float(v) for v, w in vals for _ in range(w))
    assert weighted_percentile_cont(df, "v", "w").first()[0] == pytest.approx(statistics.median(expanded), abs=1e-12)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_exact_sums_have_no_caps(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        def total(values, weights=None):
            rows = [(v, w) for v, w in zip(values, weights or [1] * len(values))]
            df = spark.createDataFrame(rows, "x double, w long")
            r = df.agg(exact_sum("x").alias("s"), exact_sum("x", "w").alias("ws"), exact_avg("x").alias("m")).first()
            return r.s, r.ws, r.m
        assert total([1e15, 2.0])[0] == 1e15 + 2 and total([1e15, 2.0])[2] == (1e15 + 2) / 2
        assert total([1e300, 1.0])[0] == 1e300
        assert total([2.0, 3.0], [10 ** 10, 10 ** 12])[1] == 2e10 + 3e12
        assert total([1e-13] * 4)[0] == pytest.approx(4e-13, rel=1e-9)
        assert total([0.1] * 10)[0] == 1.0                      # exact where doubles drift
        assert total([None, None]) == (None, None, None)
        assert total([None, 2.5], [3, 4])[1] == 10.0
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


# ---------------------------------------------------------------- plans

@contextlib.contextmanager
def _settings(spark, **conf):
    for k, v in conf.items():
        spark.conf.set(k.replace("_", "."), v)
    try:
        yield
    finally:
        for k in conf:
            spark.conf.unset(k.replace("_", "."))


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _usage(spark, tmp_path, n=60):
    rng = random.Random(6)
    e = events(spark, [dict(user_id=rng.choice([1, 1, 1, 2, 3, None]), platform=rng.choice(["web", "ios", None]), fee=rng.randrange(9),
                            datetime=T(2023, 1, rng.randrange(1, 4), rng.randrange(24), rng.randrange(60))) for _ in range(n)])
    e.write.parquet(f"{tmp_path}/events")
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{tmp_path}/events")


def test_session_plan_moves_events_once(spark, tmp_path):
    e = _usage(spark, tmp_path)
    with _settings(spark, spark_sql_autoBroadcastJoinThreshold="-1", spark_sql_adaptive_enabled="false"):
        for params in (P, P.with_(hot_key_rows=1)):
            plan = _plan(sessions.session_buckets(e, params))
            full = [line for line in plan.split("\n") if "Exchange hashpartitioning(user_id" in line and "_grp" not in line]
            windows = [line for line in plan.split("\n") if " Window [min(datetime" in line]
            assert len(windows) == 1 and "SortMergeJoin" not in plan and "NestedLoop" not in plan
            # the window's shuffle carries whole rows; the hot test shuffles counts of keys
            assert len(full) == (1 if params is P else 2)


@pytest.mark.parametrize("hot", [1, 5, 20])
def test_hot_groups_take_the_same_minimum(spark, tmp_path, hot):
    e = _usage(spark, tmp_path, 200)
    cold = sorted(map(tuple, sessions.session_buckets(e, P).collect()), key=str)
    salted = P.with_(hot_key_rows=hot, salt_rows_per_task=2)
    assert sorted(map(tuple, sessions.session_buckets(e, salted).collect()), key=str) == cold
    rows = attach_group_min(e, ["user_id", "platform"], "datetime", "least", hot_key_rows=hot, hot_key_limit=10, salt_rows_per_task=3)
    want = {(r.user_id, r.platform): r.m for r in e.groupBy("user_id", "platform").agg(F.min("datetime").alias("m")).collect()}
    assert all(r.least == want[r.user_id, r.platform] for r in rows.collect()) and rows.count() == 200


def test_no_job_runs_while_reports_are_built(spark, tmp_path):
    e = _usage(spark, tmp_path)
    u = accounts(spark, [dict(user_id=k % 4, platform="web", created_date=D(2022, 11, 1 + k), last_login=D(2023, 2, 1)) for k in range(12)])
    tables = Tables(u, e, geography(spark, [("1", "Alpha", 1.0, 1.0)]))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "no job expected")
    try:
        for name in ("rfm_base", "rfm_scores", "segment_summary", "segment_by_country", "revenue_metrics", "events_updated", "session_daily_impact"):
            REPORTS[name].fn(Derived(tables, P))
        assert list(tracker.getJobIdsForGroup("build-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_segment_scores_need_no_row_numbers(spark, tmp_path):
    e = _usage(spark, tmp_path, 300)
    u = accounts(spark, [dict(user_id=k % 4, created_date=D(2022, 10, 1 + k % 25)) for k in range(60)])
    for mode in ("original", "corrected"):
        p = P.with_(recency_mode=mode)
        plain = rfm.rfm_scores(rfm.rfm_values(sessions.sessions(e, p), u, p), p)
        ranked = rfm.rfm_scores(rfm.rfm_base(sessions.sessions(e, p), u, p), p).select(*plain.columns)
        assert sorted(map(str, plain.collect())) == sorted(map(str, ranked.collect())) and "row_number" not in _plan(plain)
        base = sorted(map(tuple, rfm.rfm_base(sessions.sessions(e, p), u, p).collect()))
        n, cut = len(base), rfm.rfm_thresholds(rfm.rfm_values(sessions.sessions(e, p), u, p), p)
        for m, (value, rank) in {"recency": (2, 5), "frequency": (3, 6), "monetary": (4, 7)}.items():
            at = {r[rank]: r[value] for r in base}
            assert sorted(at) == list(range(1, n + 1))
            assert cut[m] == [at.get(math.floor(q * n + 0.5)) for q in p.rfm_quantiles]


def test_country_engagement_keeps_one_row_a_user(spark):
    """A user with many account groups: the join sees one row per user and side."""
    u = accounts(spark, [dict(user_id=1, mp_country_code=str(1 + k % 2), created_date=D(2023, 1, 1 + k), last_login=D(2023, 2, 1 + k % 3) if k % 4 else None)
                         for k in range(24)] + [dict(user_id=2, mp_country_code="1", created_date=D(2023, 1, 5), last_login=D(2023, 1, 9))])
    e = events(spark, [dict(user_id=1, datetime=T(2023, 1, 2), fee=3, volume=2.0), dict(user_id=1, datetime=T(2023, 1, 3), fee=None, volume=1.0)])
    g = geography(spark, [("1", "Alpha", 1.0, 1.0), ("2", "Beta", 2.0, 2.0)])
    ncc = geo.number_customer_country(u, g, P)
    got = {r.country: r for r in geo.country_engagement(ncc, u, e, P.with_(min_engagement_country_users=1)).collect()}
    lives = [(D(2023, 2, 1 + k % 3) if k % 4 else P.as_of) - D(2023, 1, 1 + k) for k in range(24)]
    days = [d.days for d in lives]
    # 24 groups of user 1 in each country, 12 accounts there, 2 events each
    assert (got["Beta"].total_users, got["Beta"].engaged_users, got["Beta"].avg_events_per_user) == (24, 24, 24.0)
    assert got["Beta"].avg_user_lifespan_days == math.floor(sum(days) / 24 * 10 + .5) / 10
    assert (got["Alpha"].total_users, got["Alpha"].engaged_users) == (25, 24)


# ---------------------------------------------------------------- runner, inputs

def test_package_example_with_one_event_table(spark, tmp_path):
    e = _usage(spark, tmp_path)
    u = accounts(spark, [dict(user_id=k, platform="web", created_date=D(2022, 12, 1), last_login=D(2023, 1, 3)) for k in range(4)])
    t = Tables(u, e, geography(spark, [("1", "Alpha", 1.0, 1.0)]))
    seen = {}
    made = run_pipeline(spark, {"events": t}, f"{tmp_path}/wh", P, sink=lambda name, df: seen.update({name: df.collect()}),
                        reports=["mau_growth", "weekly_trends", "seasonal_by_top_countries", "platform_comparison"])
    assert set(seen) == {"mau_growth", "weekly_trends", "seasonal_by_top_countries", "platform_comparison"} and seen["mau_growth"]
    assert set(made) == {"number_customer_country"}          # only what a chosen report reads
    assert run_pipeline(spark, {"events": t}, f"{tmp_path}/wh2", P, reports=["platform_comparison"]) == {}


@pytest.mark.parametrize("parallel", [1, 3])
def test_impossible_steps_raise(parallel):
    with pytest.raises(ValueError, match="nobody writes"):
        _run_dag({"a": print}, {"a": ["lost"]}, parallel)
    with pytest.raises(ValueError, match="wait for each other"):
        _run_dag({"a": print, "b": print}, {"a": ["b"], "b": ["a"]}, parallel)


def test_timestamps_are_utc_and_types_are_checked(spark):
    row = spark.range(1).selectExpr("id", "1L AS user_id", "timestamp_micros(1679792400123456) AS datetime", "DATE'2023-03-26' AS date",
                                    "'web' AS platform", "1 AS volume", "2 AS fee")
    for zone in ("UTC", "America/New_York", "Europe/Berlin"):
        with _settings(spark, spark_sql_session_timeZone=zone):
            assert conform(row, "events").first().datetime.isoformat() == "2023-03-26T01:00:00.123456"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError, match="datetime is string"):
        conform(row.withColumn("datetime", F.lit("2023-01-01")), "events")
    with pytest.raises(ValueError, match="missing"):
        conform(row.drop("fee"), "events")


def test_geography_updated_serves_the_abuse_reports(spark):
    short = dict(user_id=7, created_date=D(2023, 3, 1), last_login=D(2023, 3, 2), mp_country_code="1", os="x")
    u, e = accounts(spark, [short] * 8), events(spark, [])
    t = Tables(u, e, geography(spark, [("1", "Old", 1.0, 1.0)]), geography(spark, [("1", "New", 1.0, 1.0)]))
    assert {r.country for r in REPORTS["serious_cheaters"].fn(Derived(t, P)).collect()} == {"New"}
    assert {r.country for r in REPORTS["number_customer_country"].fn(Derived(t, P)).collect()} == {"Old"}
