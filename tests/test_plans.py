"""Distributed building blocks against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens.plans.cells import weighted_percentile_cont
from cohortlens.plans.numbering import dense_row_number
from cohortlens.plans.skew import attach_group_min


def test_dense_row_number_matches_sorted_order(spark):
    rnd = random.Random(7)
    vals = [(i, rnd.randint(0, 30), rnd.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(vals, "id long, v long, w long")
    got = dense_row_number(df, [F.col("v").desc(), F.col("w").asc_nulls_first(), F.col("id")], "rn", 5)
    got = {r.id: r.rn for r in got.collect()}
    order = sorted(vals, key=lambda t: (-t[1], -1 if t[2] is None else t[2], t[0]))
    assert got == {t[0]: i + 1 for i, t in enumerate(order)}


def test_weighted_median_matches_expanded_multiset(spark):
    rnd = random.Random(3)
    for n in (1, 2, 7, 300):
        vals = [(float(rnd.randint(0, 40)), rnd.randint(1, 4)) for _ in range(n)]
        df = spark.createDataFrame(vals + [(None, 5)], "v double, w long")
        expanded = sorted(v for v, w in vals for _ in range(w))
        assert weighted_percentile_cont(df, "v", "w", 0.5, "m", 3).collect()[0].m == statistics.median(expanded)


def test_weighted_median_empty_is_null(spark):
    df = spark.createDataFrame([(None, 1)], "v double, w long")
    assert weighted_percentile_cont(df, "v", "w").collect()[0][0] is None


def test_salted_group_min_equals_plain_min(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])
        rows.append((i, key, rnd.randint(0, 10_000)))
    df = spark.createDataFrame(rows, "id long, k string, t long")
    # thresholds low enough that the hot key is salted into several parts
    got = attach_group_min(df, ["k"], "t", "m", hot_key_rows=50, hot_key_limit=2, salt_rows_per_task=40)
    got = sorted((r.id, r.m) for r in got.collect())
    mins = {}
    for _, k, t in rows:
        mins[k] = min(mins.get(k, t), t)
    assert got == sorted((i, mins[k]) for i, k, _ in rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_salted_group_min_with_many_hot_keys(spark, limit):
    """Keys above the row count and below the share, and all of them hot."""
    rnd = random.Random(5)
    rows = [(i, ["h1", "h2", "h3", None][i % 4], rnd.randint(0, 1000)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = attach_group_min(df, ["k"], "t", "m", hot_key_rows=100, hot_key_limit=limit, salt_rows_per_task=1)
    mins = {}
    for _, k, t in rows:
        mins[k] = min(mins.get(k, t), t)
    assert sorted((r.id, r.m) for r in got.collect()) == sorted((i, mins[k]) for i, k, _ in rows)


def test_row_number_partitioned_by_few_groups(spark):
    rnd = random.Random(9)
    vals = [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(vals, "id long, g string, v long")
    got = dense_row_number(df, [F.col("v").asc(), F.col("id").asc()], "rn", 4, partition_by=["g"])
    got = {r.id: r.rn for r in got.collect()}
    want = {}
    for g in ("a", "b", None):
        for i, t in enumerate(sorted((t for t in vals if t[1] == g), key=lambda t: (t[2], t[0]))):
            want[t[0]] = i + 1
    assert got == want


def test_dimension_broadcast_only_within_counted_bound(spark):
    import contextlib
    import io

    from cohortlens.plans.broadcast import dimension

    facts = spark.range(0, 2000).selectExpr("id", "cast(id % 50 as string) AS code")
    dim = spark.range(0, 50).selectExpr("cast(id as string) AS code", "id * 2 AS v")

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only the explicit hint may broadcast
    try:
        small = facts.join(dimension(dim, max_rows=100), "code")
        large = facts.join(dimension(dim, max_rows=10), "code")
        assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
        assert small.count() == large.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scale_settings_size_partitions_from_bytes():
    from cohortlens.session import scale_settings

    s = scale_settings(100 * 10 ** 12, cores=8000)
    assert int(s["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (192 << 20))
    assert scale_settings(10 ** 6, cores=8)["spark.sql.shuffle.partitions"] == "24"
    assert s["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_account_reports_scan_the_accounts_once(spark, tmp_path):
    import contextlib
    import io

    from cohortlens.operators import kpis

    users = spark.createDataFrame([], "user_id long, created_date date, last_login date, platform string, os string, feature string")
    events = spark.createDataFrame([], "id long, user_id long, date date, fee decimal(18,2), volume long")
    for name, df in (("user_info", users), ("events", events)):
        df.write.parquet(f"{tmp_path}/{name}")
    users, events = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("user_info", "events"))
    for report in (kpis.churn_status, kpis.clv_segments, kpis.platform_kpis, kpis.os_performance, kpis.feature_usage):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            report(users, events).explain()
        assert buf.getvalue().count("FileScan parquet") == 2, report.__name__   # events and accounts, once each
