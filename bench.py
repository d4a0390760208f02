"""Benchmark: the whole suite on the adapted test tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The adapted ``user_info`` / ``events`` / ``geography`` tables are first
written once as Parquet to a scratch folder (the shape real inputs
have; not timed).  The suite then runs as the original scripts do: the
derived tables (``events_updated``, ``number_customer_country``, the RFM
tables, ...) are written once in dependency order and every report
reads them; reports run to completion into Spark's ``noop`` sink, so
nothing is collected to the driver.  After ``BENCH_WARMUP`` (default 1)
uncounted run, each key's time is the median over ``BENCH_RUNS``
(default 3) pipeline runs, each in a fresh folder.

``queries`` holds the per-step medians of the sequential runs and
``sequential_total_sec`` their sum.  The pipeline is then run with
``BENCH_PARALLEL`` (default: half of ``BENCH_CPUS``, at least 2) independent
steps as concurrent Spark jobs;
``value`` is the median wall time of those runs (``BENCH_PARALLEL=1``
makes ``value`` the sequential total instead).  With
``BENCH_NAIVE=1`` (default) four reports also run as straightforward
Spark SQL plans (``tools/naive_spark_sql.py``) for comparison.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections import defaultdict

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from cohortlens.runner import run_pipeline  # noqa: E402
from cohortlens.session import build_session  # noqa: E402
from cohortlens.sources import testdata  # noqa: E402
from cohortlens.sources.tables import Tables, conform  # noqa: E402


def _sf_of(path: str):
    base = os.path.basename(path.rstrip("/"))
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return base


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    naive = os.environ.get("BENCH_NAIVE", "1") == "1"
    scratch = tempfile.mkdtemp(prefix="cohortlens-bench-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app="cohortlens-bench")

    t0 = time.time()
    testdata.write_tables(spark, sf_dir, f"{scratch}/input")
    prep = time.time() - t0

    def read(name: str, kind: str):
        return conform(spark.read.parquet(f"{scratch}/input/{name}"), kind)

    def views() -> dict[str, Tables]:
        u, g = read("user_info", "user_info"), read("geography", "geography")
        return {"events": Tables(u, read("events", "events"), g),
                "orders": Tables(u, read("order_events", "events"), g)}

    params = testdata.TEST_PARAMS
    samples: dict[str, list[float]] = defaultdict(list)
    walls = []
    warmup = int(os.environ.get("BENCH_WARMUP", "1"))
    for i in range(warmup):  # JIT / file-system caches; not counted
        run_pipeline(spark, views(), f"{scratch}/warmup{i}", params)
    derived = {}
    for i in range(runs):
        t = time.time()
        derived = run_pipeline(spark, views(), f"{scratch}/warehouse{i}", params,
                               on_step=lambda name, sec: samples[name].append(sec))
        walls.append(time.time() - t)
    results = {k: round(statistics.median(v), 3) for k, v in samples.items()}

    # the same pipeline with independent steps as concurrent Spark jobs
    parallel = int(os.environ.get("BENCH_PARALLEL", str(max(2, cpus // 2))))
    parallel_walls = []
    for i in range(runs if parallel > 1 else 0):
        t = time.time()
        run_pipeline(spark, views(), f"{scratch}/parallel{i}", params, max_parallel=parallel)
        parallel_walls.append(time.time() - t)

    naive_results: dict[str, float] = {}
    if naive:
        from tools.naive_spark_sql import NAIVE_SQL
        t_in = views()["events"]
        for view, df in (("user_info", t_in.user_info), ("events", t_in.events), ("geography", t_in.geography),
                         ("events_updated", derived["events_updated"])):
            df.createOrReplaceTempView(view)
        for name, sql in NAIVE_SQL.items():
            times = []
            for _ in range(runs):
                t = time.time()
                spark.sql(sql).write.format("noop").mode("overwrite").save()
                times.append(time.time() - t)
            naive_results[name] = round(statistics.median(times), 3)

    sequential_total = round(sum(results.values()), 3)
    headline = round(statistics.median(parallel_walls), 3) if parallel_walls else sequential_total
    out = {
        "metric": "suite_wall_sec_parallel" if parallel_walls else "suite_total_sec",
        "value": headline,
        "unit": "sec",
        "queries": results,
        "sequential_total_sec": sequential_total,
        "sf": _sf_of(sf_dir),
        "cpus": cpus,
        "runs": runs,
        "pipeline_wall_sec": [round(w, 3) for w in walls],
        "parallel_steps": parallel,
        "parallel_pipeline_wall_sec": [round(w, 3) for w in parallel_walls],
        "input_prep_sec": round(prep, 3),
    }
    if naive_results:
        out["naive_sql_sec"] = naive_results
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
