"""Readers and sinks."""

from cohortlens.operators import platform
from cohortlens.sources import testdata
from cohortlens.sources.sinks import write_table
from cohortlens.sources.tables import read_tables

SF = "/root/testdata/sf0.001"


def test_csv_inputs_match_parquet_inputs(spark, tmp_path):
    t = testdata.tables(spark, SF)
    for name, df in (("user_info", t.user_info), ("events", t.events), ("geography", t.geography)):
        df.write.option("header", "true").csv(str(tmp_path / "csv" / name))
        write_table(df, path=str(tmp_path / "pq" / name))
    from_csv = read_tables(spark, str(tmp_path / "csv"), "csv", {"header": "true"})
    from_pq = read_tables(spark, str(tmp_path / "pq"))
    assert from_csv.events.schema == from_pq.events.schema
    a = sorted(platform.platform_use(from_csv.events).collect())
    b = sorted(platform.platform_use(from_pq.events).collect())
    assert a == b and len(a) > 0
    assert from_csv.user_info.count() == t.user_info.count()


def test_catalog_and_partitioned_sinks(spark, tmp_path):
    import uuid

    from cohortlens.sources.tables import read_catalog_tables

    t = testdata.tables(spark, SF)
    db = f"cl_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path / 'db'}'")
    for name, df in (("user_info", t.user_info), ("events", t.events), ("geography", t.geography)):
        write_table(df, table=f"{db}.{name}")
    back = read_catalog_tables(spark, db)
    assert back.events.count() == t.events.count() and back.geography.count() == 25
    write_table(t.events, path=str(tmp_path / "by_date"), partition_by=["date"])
    by_date = spark.read.parquet(str(tmp_path / "by_date"))
    day = sorted(r.date for r in t.events.select("date").distinct().collect())[0]
    pruned = by_date.filter(by_date.date == day)
    assert pruned.count() == t.events.filter(t.events.date == day).count()


def test_command_line_runs_the_suite(spark, tmp_path):
    from cohortlens.__main__ import main
    from cohortlens.suite import DERIVED_TABLES, REPORTS

    inp = tmp_path / "in"
    testdata.write_tables(spark, SF, str(inp))
    times = main(["--input", str(inp), "--warehouse", str(tmp_path / "wh"), "--output", str(tmp_path / "out"),
                  "--as-of", "2024-02-01", "--month-events", str(inp / "order_events"), "--parallel", "2",
                  "--param", "min_country_users=50", "--param", "engagement_classes=60,45,30,15"], spark)
    reports = set(REPORTS) - set(DERIVED_TABLES)
    assert reports <= set(times)
    assert spark.read.parquet(str(tmp_path / "out" / "segment_summary")).count() > 0
    assert spark.read.parquet(str(tmp_path / "wh" / "events_updated")).count() > 0
