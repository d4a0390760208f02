"""Run the whole suite as a pipeline.

Derived tables are written first, in dependency order, to a warehouse
folder (shared storage on a cluster) and read back, so every report
reads the materialised table instead of recomputing it — and the
lineage of everything downstream is cut at each table.  Two shared
intermediates are materialised the same way: per-user event totals
(one pass over the events for all ten account x event reports) and the
per-key before/after session counts (for the four session reports).
The per-user totals are stored bucketed by ``user_id`` with as many
buckets as shuffle partitions, so the ten reports that join them on
``user_id`` read that side without a shuffle.  Reports are then handed
to ``sink(name, df)``.

With ``max_parallel > 1`` independent steps run as concurrent Spark jobs
from a thread pool; derived tables and reports form one dependency graph
(a step starts as soon as the tables it reads exist), so reports over the
base tables run while the session and RFM chain is still being built.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .params import DEFAULT, Params
from .sources.sinks import write_bucketed, write_table
from .sources.tables import Tables
from .suite import DERIVED_TABLES, REPORTS, SHARED_TABLES, Derived

Sink = Callable[[str, DataFrame], None]
Hook = Callable[[str, float], None]

# tables that do not depend on the event table (shareable across event views)
ACCOUNT_SIDE_TABLES = {"number_customer_country"}

# shared tables stored bucketed by this key (every reader joins on it)
BUCKETED = {"user_event_totals": "user_id"}

# which materialised tables each derived step reads (others read base tables only)
TABLE_DEPENDENCIES = {
    "session_key_stats": ["events_updated"],
    "rfm_base": ["events_updated"],
    "rfm_scores": ["rfm_base"],
    "rfm_segments": ["rfm_scores"],
}


def noop_sink(name: str, df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _ordered(steps: dict[str, Callable[[], None]], deps: dict[str, list[str]]) -> list[str]:
    """Steps after all they need; raises for a need that is no step and for a cycle."""
    missing = {name: [d for d in deps.get(name, []) if d not in steps] for name in steps}
    if missing := {name: lost for name, lost in missing.items() if lost}:
        raise ValueError(f"steps that need tables nobody writes: {missing}")
    out: list[str] = []
    while len(out) < len(steps):
        ready = [name for name in steps if name not in out and all(d in out for d in deps.get(name, []))]
        if not ready:
            raise ValueError(f"steps that wait for each other: {sorted(set(steps) - set(out))}")
        out += ready
    return out


def _run_dag(steps: dict[str, Callable[[], None]], deps: dict[str, list[str]], max_parallel: int) -> None:
    order = _ordered(steps, deps)
    if max_parallel <= 1:
        for name in order:
            steps[name]()
        return
    with ThreadPoolExecutor(max_workers=max_parallel) as pool:
        pending, running, done = dict(steps), {}, set()
        while pending or running:
            for name in [n for n in pending if all(d in done for d in deps.get(n, []))]:
                running[pool.submit(pending.pop(name))] = name
            finished, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in finished:
                f.result()  # re-raise a failed step
                done.add(running.pop(f))


def _needed(chosen: list[str]) -> set[str]:
    """Tables that the chosen reports are, or read, directly or through other tables."""
    out: set[str] = set()
    todo = [t for name in chosen for t in ([name] if name in DERIVED_TABLES else REPORTS[name].needs)]
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += TABLE_DEPENDENCIES.get(name, [])
    return out


def run_pipeline(spark: SparkSession, views: dict[str, Tables], warehouse: str, params: Params = DEFAULT,
                 sink: Sink = noop_sink, on_step: Hook | None = None,
                 reports: list[str] | None = None, max_parallel: int = 1) -> dict[str, DataFrame]:
    """``views["events"]`` holds the main tables; other keys (e.g. ``"orders"``)
    serve reports registered with that event view, which read the main tables
    where there is no such key.  ``reports``: only these, with only the tables
    they need; all by default.  Returns the materialised derived tables."""
    base = warehouse.rstrip("/")
    main = Derived(views["events"], params)

    def timed(name: str, action: Callable[[], None]) -> Callable[[], None]:
        def run() -> None:
            t0 = time.time()
            action()
            if on_step:
                on_step(name, time.time() - t0)
        return run

    run_id = uuid.uuid4().hex[:12]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def materialise(name: str, build: Callable[[Derived], DataFrame]) -> Callable[[], None]:
        def action() -> None:
            path = f"{base}/{name}"
            if name in BUCKETED:
                main.materialized[name] = write_bucketed(build(main), path, f"cohortlens_{run_id}_{name}",
                                                         BUCKETED[name], buckets)
                return
            df = build(main)
            write_table(df, path=path)
            main.materialized[name] = spark.read.schema(df.schema).parquet(path)
        return timed(name, action)

    unknown = set(reports or ()) - set(REPORTS)
    if unknown:
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    chosen = [name for name in REPORTS if not reports or name in reports]
    tables = _needed(chosen) if reports else {*DERIVED_TABLES, *SHARED_TABLES}
    steps = {name: materialise(name, REPORTS[name].fn) for name in DERIVED_TABLES if name in tables}
    steps.update({name: materialise(name, build) for name, build in SHARED_TABLES.items() if name in tables})
    deps = {name: TABLE_DEPENDENCIES[name] for name in steps if name in TABLE_DEPENDENCIES}

    def report_step(name: str) -> Callable[[], None]:
        report = REPORTS[name]

        def action() -> None:
            if report.event_view == "events" or report.event_view not in views:
                d = main
            else:  # another event table: only tables built from accounts alone are shared
                d = Derived(views[report.event_view], params,
                            {k: main.materialized[k] for k in report.needs if k in ACCOUNT_SIDE_TABLES})
            sink(name, report.fn(d))
        return timed(name, action)

    for name in chosen:
        if name not in DERIVED_TABLES:
            steps[name] = report_step(name)
            deps[name] = list(REPORTS[name].needs)
    _run_dag(steps, deps, max_parallel)
    return dict(main.materialized)
