"""Run the whole suite from the command line.

    python -m cohortlens --input s3://bucket/usage --warehouse s3://bucket/wh \\
        --output s3://bucket/reports --as-of 2023-04-01 --parallel 4

(the Spark session comes from the environment: spark-defaults.conf,
``PYSPARK_SUBMIT_ARGS`` or a cluster launcher).

``--input`` holds ``user_info/``, ``events/`` and ``geography/`` (any Spark
source format, ``--format``); derived tables go to ``--warehouse`` and one
Parquet folder per report to ``--output``.  With ``--month-events`` a second
event table (e.g. a longer history) serves the monthly / weekly trend reports.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt

from pyspark.sql import SparkSession

from .params import Params
from .runner import run_pipeline
from .sources.sinks import write_table
from .sources.tables import SCHEMAS, Tables, conform, read_tables


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    ap = argparse.ArgumentParser(prog="cohortlens", description=__doc__.split("\n\n")[0])
    ap.add_argument("--input", required=True)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--as-of", default=None, help="reporting date, YYYY-MM-DD")
    ap.add_argument("--reports", default="", help="comma-separated keys (default: all)")
    ap.add_argument("--parallel", type=int, default=4)
    ap.add_argument("--month-events", default=None, help="event table for monthly/weekly trends")
    ap.add_argument("--param", action="append", default=[], help="NAME=VALUE override of a Params field")
    args = ap.parse_args(argv)

    spark = spark or SparkSession.builder.appName("cohortlens").getOrCreate()
    params = Params()
    if args.as_of:
        params = params.with_(as_of=dt.date.fromisoformat(args.as_of))
    fields = {f.name: f for f in dataclasses.fields(Params)}
    for item in args.param:
        name, value = item.split("=", 1)
        current = getattr(params, name)
        if isinstance(current, tuple):
            typed = tuple(type(current[0])(v) for v in value.split(","))
        elif isinstance(current, dt.date):
            typed = dt.date.fromisoformat(value)
        else:      # fields that are unset by default are row bounds
            typed = int(value) if current is None else type(current)(value)
        params = params.with_(**{fields[name].name: typed})

    tables = read_tables(spark, args.input, args.format)
    views = {"events": tables}
    if args.month_events:
        month = conform(spark.read.format(args.format).schema(SCHEMAS["events"]).load(args.month_events), "events")
        views["orders"] = Tables(tables.user_info, month, tables.geography)
    else:
        views["orders"] = tables

    out = args.output.rstrip("/")
    times: dict[str, float] = {}
    run_pipeline(spark, views, args.warehouse, params,
                 sink=lambda name, df: write_table(df, path=f"{out}/{name}"),
                 on_step=lambda name, sec: times.__setitem__(name, round(sec, 3)),
                 reports=[r for r in args.reports.split(",") if r] or None, max_parallel=args.parallel)
    return times


if __name__ == "__main__":
    for step, sec in sorted(main().items(), key=lambda kv: -kv[1]):
        print(f"{step:32s} {sec:8.3f} s")
