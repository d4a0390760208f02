"""As-of join: each left row meets the latest right row of its key at or before it.

Both sides go into one union, sorted within (key, bin of time); the latest right
row is carried forward by a window.  What a bin inherits from earlier bins is the
last right row of each (key, bin), carried over bins by a second window that
holds one row a bin.  A key with a third of all rows is spread over its bins, and
no pair of a left row and an earlier right row is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str,
               bin_of: Callable[[Column], Column], match: str = "match") -> DataFrame:
    """Every row of ``left`` with a column ``match``: the struct (right_at, then the
    other columns of ``right``) of the right row with the same ``by`` and the
    greatest ``right_at`` that is not after ``left_at``; null where there is none.

    Equal ``right_at``: the greatest struct.  Left rows without key or time match
    nothing and stay; right rows without key or time are left out.  ``bin_of``
    maps a time to a number that never falls as time grows; times of both sides
    have one type.  ``match`` must not be a column of ``left``."""
    r = right.filter(F.col(by).isNotNull() & F.col(right_at).isNotNull())
    r = r.select(F.col(by).alias("_k"), F.col(right_at).alias("_t"),
                 F.struct(right_at, *[c for c in right.columns if c not in (by, right_at)]).alias("_r"))
    has_place = F.col(by).isNotNull() & F.col(left_at).isNotNull()
    kept = left.select(F.col(by).alias("_k"), F.col(left_at).alias("_t"), has_place.alias("_placed"), F.struct(*left.columns).alias("_l"))
    nothing = F.lit(None).cast(r.schema["_r"].dataType)
    rows = (r.select("_k", "_t", "_r", F.lit(None).cast(kept.schema["_l"].dataType).alias("_l"))
            .unionAll(kept.filter("_placed").select("_k", "_t", nothing.alias("_r"), "_l"))
            .withColumn("_bin", bin_of(F.col("_t"))))
    so_far = Window.partitionBy("_k", "_bin").orderBy("_t", F.col("_l").isNotNull(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_in", F.last("_r", ignorenulls=True).over(so_far)).filter(F.col("_l").isNotNull())
    earlier = Window.partitionBy("_k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.groupBy("_k", "_bin").agg(F.max("_r").alias("_last"))
               .select("_k", "_bin", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
               .filter(F.col("_before").isNotNull()))
    met = inside.join(carried, ["_k", "_bin"], "left").select("_l.*", F.coalesce("_in", "_before").alias(match))
    return met.unionAll(kept.filter(~F.col("_placed")).select("_l.*", nothing.alias(match)))
