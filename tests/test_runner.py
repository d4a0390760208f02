"""The pipeline (materialised CTAS + shared tables, concurrent steps) equals the stand-alone reports."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

from cohortlens.runner import run_pipeline
from cohortlens.sources import testdata
from cohortlens.suite import DERIVED_TABLES, REPORTS, SHARED_TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("max_parallel", [1, 4])
def test_pipeline_matches_standalone(spark, tmp_path, max_parallel):
    views = {"events": testdata.tables(spark, SF), "orders": testdata.tables(spark, SF, "orders")}
    got, steps = {}, []
    derived = run_pipeline(spark, views, str(tmp_path / "wh"), testdata.TEST_PARAMS,
                           sink=lambda name, df: got.__setitem__(name, entry._decimals_as_double(df).toPandas()),
                           on_step=lambda name, sec: steps.append(name), max_parallel=max_parallel)
    for name in DERIVED_TABLES:
        got[name] = entry._decimals_as_double(derived[name]).toPandas()
    assert set(got) == set(REPORTS)
    assert set(steps) == set(REPORTS) | set(SHARED_TABLES)
    for name in REPORTS:
        want = entry.queries()[name](spark, SF).toPandas()
        r = compare(got[name], want)
        assert r["cols_match"] and r["spark_rows"] == r["oracle_rows"] and r["tolerant"], (name, r)
