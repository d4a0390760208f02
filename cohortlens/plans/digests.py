"""Compare two versions of a table by order-free digests.

A digest of a set of rows is its row count and two sums of independent 64-bit
row hashes: it does not depend on the order of rows, repeated rows count, and
partial digests add up, so a group of any size is combined map-side.  Groups
of equal digests hold the same rows (two sums of 64 bits would have to agree by
chance), so only the rows of differing groups are shuffled and compared value
by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SUM = "decimal(28,0)"       # sums to decimal(38,0): 10^18 rows a group


def _hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two hashes of a row.  Spark's hash skips nulls, so null flags are hashed too."""
    cols = [c for name in columns for c in (F.col(name), F.col(name).isNull())]
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def digests(df: DataFrame, group: dict[str, Column], columns: list[str] | None = None) -> DataFrame:
    """``group``, n_rows, sum_1, sum_2 per group of rows."""
    one, two = _hashes(columns or df.columns)
    return (df.groupBy(*[c.alias(k) for k, c in group.items()])
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(one.cast(HASH_SUM)).alias("sum_1"),
                 F.sum(two.cast(HASH_SUM)).alias("sum_2")))


def differing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The groups (null keys are one) whose digests differ or that one side lacks: ``keys``
    and the new side's digest, with no rows where the group is gone."""
    a, b = old.alias("a"), new.alias("b")
    parts = ["n_rows", "sum_1", "sum_2"]
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    equal = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in parts])
    found = F.col("b.n_rows").isNotNull()
    return (a.join(b, same, "full").filter(~equal)
            .select(*[F.when(found, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys],
                    F.coalesce(F.col("b.n_rows"), F.lit(0)).alias("n_rows"),
                    *[F.coalesce(F.col(f"b.{c}"), F.lit(0).cast("decimal(38,0)")).alias(c) for c in parts[1:]]))


def multiset_diff(old: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Rows that ``new`` lacks or has more of: the columns, ``n_old`` and ``n_new``, where
    they differ (EXCEPT ALL of both directions at once; nulls are equal).

    Rows are dealt to ``buckets`` by hash.  Both sides are scanned for their bucket
    digests; the list of differing buckets is broadcast (at most ``buckets`` numbers),
    and only their rows are shuffled, after copies of a row were counted map-side.
    Both frames need the same columns, of types that can be grouped."""
    if old.columns != new.columns:
        raise ValueError(f"different columns: {old.columns}, {new.columns}")
    columns = old.columns
    bucket = F.pmod(_hashes(columns)[0], F.lit(buckets))
    changed = F.broadcast(differing(*[digests(d, {"_bucket": bucket}) for d in (old, new)], keys=["_bucket"]).select("_bucket"))

    def rows(df: DataFrame, is_new: int) -> DataFrame:
        return df.withColumn("_bucket", bucket).join(changed, "_bucket", "left_semi").select(*columns, F.lit(is_new).alias("_new"))

    n_new = F.sum("_new")
    return (rows(old, 0).unionByName(rows(new, 1)).groupBy(*columns)
            .agg((F.count(F.lit(1)) - n_new).alias("n_old"), n_new.alias("n_new"))
            .filter(F.col("n_old") != F.col("n_new")))
