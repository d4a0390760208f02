"""Global row numbers over any order without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY makes Spark move
every row into one task.  Instead:

1. range-partition on the (total) order and sort inside each partition;
2. tag each row with its partition and its position inside it
   (``monotonically_increasing_id`` is consecutive within a partition);
3. materialise the tagged rows as a Parquet table under
   ``spark.checkpoint.dir`` (one job; the lineage is cut, so both passes
   below read the same rows even if executors are lost and work is
   recomputed — partition and position travel as columns);
4. count rows per partition (one row per partition — a proven bound),
   turn the counts into offsets with a tiny window, broadcast them and
   add them to the local positions.

``plans.cells`` numbers by the values of one column without a write; this way
takes any list of sort expressions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back
    (cuts the lineage; shared, reliable storage on a cluster)."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/cohortlens-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # known schema: no footer-reading job


def _staged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    # without an explicit count AQE sizes the range partitions by data volume;
    # coalesced partitions are still contiguous key ranges in order
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    staged = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
    )
    return reliable_checkpoint(staged)


def _offsets(staged: DataFrame, weight: Column) -> DataFrame:
    per_part = staged.groupBy("_pid").agg(F.sum(weight).alias("_part_total"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_pid", "_part_total",
        F.coalesce(F.sum("_part_total").over(before), F.lit(0)).cast("long").alias("_offset"))


def dense_row_number(df: DataFrame, order: list[Column], out: str = "rn",
                     num_partitions: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` plus ``out`` = 1..N in ``order`` (a total order), restarting per
    value of ``partition_by`` — ``ROW_NUMBER() OVER ([PARTITION BY g] ORDER BY
    order)`` without putting a group in one task.

    ``partition_by`` is meant for a few large groups: rows are range-sorted
    on (group, order), and the offsets table has one row per (range
    partition, group), which is what gets broadcast."""
    groups = partition_by or []
    staged = _staged(df, [F.col(g).asc_nulls_first() for g in groups] + order, num_partitions)
    if not groups:
        offsets = _offsets(staged, F.lit(1))
        return (staged.join(F.broadcast(offsets.select("_pid", "_offset")), "_pid")
                .withColumn(out, (F.col("_offset") + F.col("_local") + 1).cast("long"))
                .drop("_pid", "_local", "_offset"))
    per = staged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_start"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_pid").alias("_o_pid"), "_start",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = F.broadcast(offsets)  # (range partitions) x (groups) rows
    on = reduce(lambda a, b: a & b, [staged[g].eqNullSafe(offsets[f"_o_{g}"]) for g in groups]) \
        & (staged["_pid"] == offsets["_o_pid"])
    return (staged.join(offsets, on)
            .withColumn(out, (F.col("_offset") + F.col("_local") - F.col("_start") + 1).cast("long"))
            .drop("_pid", "_local", "_offset", "_start", "_o_pid", *[f"_o_{g}" for g in groups]))
