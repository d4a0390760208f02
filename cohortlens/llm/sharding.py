"""Sharding by a two-pass external shuffle of whole rows.

Pass one scatters the rows, texts and all, uniformly over buckets of about
``bucket_rows`` rows and at most about ``bucket_bytes`` bytes by a seeded
hash; a row of more bytes than that has a bucket of its own.  Each bucket is
shuffled by Fisher-Yates (Spark's seeded ``shuffle``) and written.  Pass two
reads the buckets and deals their rows out in turn into the shards, so shard
sizes differ by one row at most (law ``rows``).

The scatter hash covers the row's place in its input split, so copies and
repeated ids, however many, spread like any other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from .common import materialise, scratch_path

SHARDS = 8
SEED = 17
BUCKET_ROWS = 1024
BUCKET_BYTES = 1 << 20
_PLACE_BITS = 33      # monotonically_increasing_id: partition above, place in it below


def _row_bytes(rows: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, nested values as text."""
    def size(name: str, kind) -> Column:
        if isinstance(kind, AtomicType) and not isinstance(kind, (StringType, BinaryType)):
            return F.lit(8)
        value = rows[name] if isinstance(kind, (StringType, BinaryType)) else rows[name].cast("string")
        return F.coalesce(F.octet_length(value), F.lit(0))

    return sum((size(f.name, f.dataType).cast("long") for f in rows.schema.fields), F.lit(0).cast("long"))


def fill_buckets(rows: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """bucket, own, rows: the whole rows of each bucket as (at, row), in order
    of their hash ``at``.  ``own`` is null but for a row of its own bucket."""
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(rows)), F.lit(0))).first()
    buckets = max(1, math.ceil(count / bucket_rows), math.ceil(total / bucket_bytes))
    numbered = rows.select(F.monotonically_increasing_id().alias("id"), _row_bytes(rows).alias("bytes"),
                           F.struct(*[rows[c] for c in rows.columns]).alias("row"))
    at = F.xxhash64(F.lit(seed), "id")
    scattered = numbered.select(F.pmod(at, F.lit(buckets)).alias("bucket"), F.when(F.col("bytes") > bucket_bytes, F.col("id")).alias("own"),
                                F.struct(at.alias("at"), "row").alias("r"))
    # sorted first, so that the shuffle does not depend on the order of arrival
    by_hash = F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return scattered.groupBy("bucket", "own").agg(by_hash.alias("rows"))


def _without_clashes(rows: DataFrame) -> DataFrame:
    """``rows`` with an underscore after the names that the placement needs."""
    taken, names = {"shard", "slot", *(c.lower() for c in rows.columns)}, []
    for c in rows.columns:
        name = c
        while name.lower() in ("shard", "slot") or name != c and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return rows.toDF(*names)


def place_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
               bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` with their ``shard`` (0 to shards - 1) and ``slot`` (gapless
    from 0 in each shard); own columns of these names get an underscore.  Nulls are values like any other; an empty table
    gives an empty result.

    The shuffled buckets are written once, every row with its partition and
    its place there; a partition's first turn comes from the row counts of
    the partitions before it (one number a partition)."""
    spark = rows.sparkSession
    rows = _without_clashes(rows)
    mixed = fill_buckets(rows, seed, bucket_rows, bucket_bytes).select(F.explode(F.shuffle("rows", seed)).alias("r"))
    mixed = materialise(mixed.select(F.monotonically_increasing_id().alias("place"), F.col("r.row").alias("row")), "shard-buckets")
    part = F.shiftright("place", _PLACE_BITS).alias("part")
    firsts, before = [], 0
    for r in sorted(mixed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()):
        firsts.append((r["part"], before))
        before += r["n"]
    firsts = spark.createDataFrame(firsts, "part long, first long")
    dealt = mixed.select(part, "place", "row").join(F.broadcast(firsts), "part")
    turn = F.col("first") + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return dealt.select("row.*", F.pmod(turn, F.lit(shards)).cast("int").alias("shard"),
                        F.floor(turn / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, tasks: int | None = None) -> DataFrame:
    """Write whole rows as Parquet under ``path``/shard=N and return them read
    back (columns of ``docs``, slot, shard).  Each file is in slot order; a
    shard's files may interleave, the order over all of them is ``slot``.

    At most ``tasks`` tasks write.  Columns of ``docs`` named shard or slot come
    back as shard_ and slot_."""
    whole = place_rows(docs, shards, seed)
    if tasks:
        whole = whole.coalesce(tasks)
    whole.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(whole.schema).parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of
    ``docs``, all taken from the shard files, which hold the whole rows.  They
    are written to ``path`` (default: a new folder under the shared one).
    Null texts have no bytes (size 1, crc32 of nothing)."""
    back = write_shards(docs, path or scratch_path(docs.sparkSession, "shards"), shards, seed)
    text = F.coalesce(back["text"], F.lit(""))
    return back.select(back["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
