"""Attach a per-group minimum to every row with one shuffle and no hot-key straggler.

``MIN(x) OVER (PARTITION BY keys)`` puts a whole group into one task, so hot
groups take another way:

* hot test: key columns alone of every n-th row are counted, about
  ``SAMPLE_ROWS`` rows a hot group.  A group is hot above ``hot_key_rows`` rows
  when it also holds more than ``1 / hot_key_limit`` of the rows of all such
  groups; fewer than ``hot_key_limit`` groups can, so their list is bounded
  without cutting it, and is broadcast.  The sample decides the way a group
  takes, never its result;
* a hot group's minimum is a map-side-combined aggregate over the rows of hot
  groups only, broadcast with their list;
* all rows then go through one window by keys and a salt.  Cold rows have salt
  0 and take the window's minimum; rows of hot groups spread over
  ``ceil(rows / salt_rows_per_task)`` salts by a hash of their content and take
  the group's minimum.

A table that by Spark's own estimate is smaller than ``hot_key_rows`` rows of
``ROW_BYTES`` bytes is not tested: none of its groups can be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 1000
ROW_BYTES = 8


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_h_{k}"]) for k in keys])


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file sizes for scans); reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach_group_min(df: DataFrame, keys: list[str], value: str, out: str, *,
                     hot_key_rows: int, hot_key_limit: int, salt_rows_per_task: int) -> DataFrame:
    """``df`` with ``out``, the minimum of ``value`` in the row's group of ``keys`` (nulls are a group)."""
    if estimated_bytes(df) < hot_key_rows * ROW_BYTES:
        return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys)))
    step = max(1, hot_key_rows // SAMPLE_ROWS)
    sample = df.select(*keys).filter(F.pmod(F.monotonically_increasing_id(), F.lit(step)) == 0) if step > 1 else df.select(*keys)
    large = (sample.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(step)).alias("_rows"))
             .filter(F.col("_rows") > hot_key_rows))
    share = F.sum("_rows").over(Window.partitionBy()) / F.lit(hot_key_limit)       # over the groups above hot_key_rows alone
    hot = large.withColumn("_share", share).filter(F.col("_rows") > F.col("_share")).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("_rows") / F.lit(salt_rows_per_task)).cast("int").alias("_hs"))
    hot = F.broadcast(hot)                      # fewer than hot_key_limit rows, by their share
    named = [f"_h_{k}" for k in keys]
    least = F.broadcast(df.select(*keys, value).join(hot, _same(df, hot, keys))
                        .groupBy(*named).agg(F.min(value).alias("_h_least"), F.max("_hs").alias("_hs")))
    salt = F.when(F.col("_hs").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.col("_hs")).cast("int"))
    rows = df.join(least, _same(df, least, keys), "left").withColumn("_salt", salt).drop(*named)
    cold = F.min(value).over(Window.partitionBy(*keys, "_salt"))
    return (rows.withColumn("_cold", cold)
            .withColumn(out, F.when(F.col("_hs").isNull(), F.col("_cold")).otherwise(F.col("_h_least")))
            .drop("_cold", "_salt", "_hs", "_h_least"))
