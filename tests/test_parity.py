"""Every registered report against its independently written DuckDB SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlens.suite import EXTENSIONS, REPORTS
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_report_has_oracle_sql():
    assert set(REPORTS) <= set(entry.queries()) and set(REPORTS) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(REPORTS) == 51


@pytest.mark.parametrize("name", sorted({*REPORTS, *EXTENSIONS} & set(entry.oracle_sql())))
def test_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    r = compare(got, want)
    assert r["cols_match"], r.get("cols")
    assert r["spark_rows"] == r["oracle_rows"]
    assert r["tolerant"], r.get("first_diff")


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "customer_segment" in df.columns
