"""

usage: python tools/dump_plans.py [sf_dir] [out_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortlens.session import build_session  # noqa: E402
from cohortlens.sources import testdata  # noqa: E402
from cohortlens.sources.tables import read_parquet_tables  # noqa: E402
from cohortlens.suite import REPORTS, Derived  # noqa: E402
from tools.naive_spark_sql import NAIVE_SQL  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    out = argv[2] if len(argv) > 2 else os.path.join(ROOT, "docs", "plans")
    os.makedirs(out, exist_ok=True)
    spark = build_session("local[8]", 8)
    base = tempfile.mkdtemp(prefix="cohortlens-plans-")
    t = testdata.tables(spark, sf_dir)
    for name, df in (("user_info", t.user_info), ("events", t.events), ("geography", t.geography)):
        df.write.parquet(f"{base}/{name}")
    t = read_parquet_tables(spark, base)
    for name, df in (("user_info", t.user_info), ("events", t.events), ("geography", t.geography)):
        df.createOrReplaceTempView(name)
    for key, sql in NAIVE_SQL.items():
        with open(os.path.join(out, f"{key}.naive.txt"), "w") as f:
            f.write(plan(spark.sql(sql)))
        with open(os.path.join(out, f"{key}.optimised.txt"), "w") as f:
            f.write(plan(REPORTS[key].fn(Derived(t, testdata.TEST_PARAMS))))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
