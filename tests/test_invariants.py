"""Invariants on the adapted test data, and plan shape checks."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import geography as geo
from cohortlens.operators import platform, retention, rfm, sessions
from cohortlens.sources import testdata
from cohortlens.sources.tables import read_parquet_tables
from cohortlens.suite import REPORTS, Derived

SF = "/root/testdata/sf0.001"
P = testdata.TEST_PARAMS


@pytest.fixture(scope="module")
def tables(spark):
    return testdata.tables(spark, SF)


def plan_of(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def parquet_tables(spark, tables, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("inputs"))
    tables.user_info.write.parquet(f"{base}/user_info")
    tables.events.write.parquet(f"{base}/events")
    tables.geography.write.parquet(f"{base}/geography")
    return read_parquet_tables(spark, base)


def test_sessions_conserve_volume_and_fee(tables):
    known = tables.events.filter(F.col("user_id").isNotNull())
    eu = sessions.events_updated(tables.events, P)
    a = known.agg(F.sum("volume"), F.sum("fee"), F.count("*")).collect()[0]
    b = eu.agg(F.sum("volume"), F.sum("fee"), F.count("*"), F.min("id"), F.max("id"),
               F.countDistinct("id")).collect()[0]
    assert (a[0], a[1]) == (b[0], b[1])
    assert b[2] <= a[2]
    assert (b[3], b[4], b[5]) == (1, b[2], b[2])  # ids are exactly 1..N


def test_one_row_per_session_key_and_bucket(tables):
    b = sessions.session_buckets(tables.events, P)
    assert b.filter(~F.col("_grp").between(1, 4)).count() == 0
    assert b.groupBy("user_id", "date", "platform", "_grp").count().filter("count > 1").count() == 0


def test_retention_non_increasing(tables):
    rows = retention.retention_intervals(tables.user_info, P).collect()
    for r in rows:
        vals = [float(r[f"day{k}_retention"].rstrip("%")) for k in range(1, 8)]
        assert all(x >= y for x, y in zip(vals, vals[1:]))


def test_rfm_reference_mode_properties(tables):
    seg = rfm.rfm_segments(rfm.rfm_scores(rfm.rfm_base(sessions.sessions(tables.events, P), tables.user_info, P), P))
    got = seg.collect()
    assert {r.R for r in got} <= {1, 4}
    assert "Other" not in {r.customer_segment for r in got}
    summary = rfm.segment_summary(seg).collect()
    assert abs(sum(r.percentage for r in summary) - 100) < 0.1
    assert sum(r.customer_count for r in summary) == len(got)


def test_platform_shares_total_100(tables):
    ncc = geo.number_customer_country(tables.user_info, tables.geography, P)
    by_country = {}
    for r in geo.os_by_top_countries(ncc, tables.user_info, P).collect():
        by_country[r.country] = by_country.get(r.country, 0) + r.os_share
    assert by_country and all(abs(v - 100) < 0.1 for v in by_country.values())


# ---------------------------------------------------------------- plan shape

def test_no_python_udfs_or_cross_joins_anywhere(spark, tables):
    views = {"events": Derived(tables, P), "orders": Derived(testdata.tables(spark, SF, "orders"), P)}
    for name, report in REPORTS.items():
        text = plan_of(report.fn(views[report.event_view]))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                     "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text, (name, node)


def test_retention_is_one_aggregation_shuffle(parquet_tables):
    text = plan_of(retention.retention_intervals(parquet_tables.user_info, P), "simple")
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("FileScan parquet") == 1
    assert "Join" not in text


def test_no_global_row_number_window(tables):
    text = plan_of(sessions.events_updated(tables.events, P))
    assert "row_number" not in text.lower()


def test_filter_and_columns_reach_parquet_scan(parquet_tables):
    text = plan_of(platform.platform_comparison(parquet_tables.events))
    assert "PushedFilters: [IsNotNull(user_id)]" in text
    scan = [line for line in text.splitlines() if "ReadSchema" in line][0]
    fields = {f.split(":")[0] for f in scan.split("struct<", 1)[1].rstrip(">").split(",") if ":" in f}
    assert fields == {"user_id", "platform", "volume", "fee"}


def test_salted_sessions_equal_unsalted_on_real_data(tables):
    """Every (user, platform, date) group with more than 2 rows is treated as hot
    and split into salts of 2 rows; the session table must not change."""
    salted_params = P.with_(hot_key_rows=2, hot_key_limit=1_000_000, salt_rows_per_task=2)
    cols = ["user_id", "date", "platform", "_grp", "datetime", "volume", "fee", "_events"]
    plain = sorted(tuple(r) for r in sessions.session_buckets(tables.events, P).select(*cols).collect())
    salted = sorted(tuple(r) for r in sessions.session_buckets(tables.events, salted_params).select(*cols).collect())
    assert plain == salted and len(plain) > 0


def test_batch_reports_do_not_depend_on_session_time_zone(spark, tables):
    from cohortlens.operators import kpis
    before = spark.conf.get("spark.sql.session.timeZone")
    results = []
    try:
        for tz in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            results.append((sorted(map(tuple, kpis.peak_hours(tables.events).collect())),
                            sorted(map(tuple, sessions.session_buckets(tables.events, P).collect()))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert results[0] == results[1] == results[2]
