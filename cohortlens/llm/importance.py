"""Importance resampling towards a target distribution.

Every run of one to ``runs`` words is hashed into one of ``buckets``
buckets.  A bucket's gain is its log ratio of target to corpus frequency; a
document's weight is the mean gain of its runs, read from one array of gains.
Seeded Gumbel noise on top of the weight makes the highest scores a weighted
sample without replacement.

Ranks come from a distributed LSD radix sort.  The composite key (score
descending, null ids last, id ascending) is cut into digits of ``DIGIT_BITS``
bits.  Rows lie in blocks of ``BLOCK_ROWS``; each pass counts the digits of
every block, turns the counts into global prefix offsets and moves every row
to its destination, so a pass is one shuffle of narrow rows by block and one
written table.  Blocks are equally full whatever the keys are, so no score or
id, however frequent, loads a task.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices, texts_of
from .wordarrays import ALNUM_WORDS, Words, lower_ascii, utf8

BUCKETS = 10_000
RUNS = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 14
_LONG_WORD = 256     # words of more bytes are fed to zlib one by one
_PLACE_BITS = 33     # monotonically_increasing_id: partition above, place in it below
_ROW = "doc_id long, n_words long, n_features long, weight long, score long, text_key long"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc_feed(crc: np.ndarray, data: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's crc32 of many byte runs at once: entry i goes on from ``crc[i]``
    with the bytes ``starts[i]:ends[i]``.  All runs advance a byte a step,
    longest first, so a step touches only runs that still have a byte."""
    lens = ends - starts
    out = np.empty(len(lens), dtype=np.uint32)
    order = np.argsort(-lens, kind="stable")
    longs = int(np.searchsorted(-lens[order], -_LONG_WORD, side="left"))
    for i in order[:longs]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(crc[i]))
    order = order[longs:]
    at, state = starts[order], ~crc[order]
    falling = -lens[order]
    for step in range(int(-falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -step, side="left"))
        head = state[:n]
        state[:n] = (head >> np.uint32(8)) ^ _TABLE[(head ^ buf[at[:n] + step]) & np.uint32(255)]
    out[order] = ~state
    return out


def bucketed_runs(words: Words, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every run of 1 to ``runs`` words, one space apart."""
    n = len(words)
    owner = np.repeat(np.arange(len(words.doc_first) - 1), np.diff(words.doc_first))
    last = words.doc_first[1:][owner] if n else owner
    crc = crc_feed(np.zeros(n, np.uint32), words.data, words.buf, words.starts, words.ends)
    first = np.arange(n)
    found, rows = [crc], [owner]
    space = np.frombuffer(b" ", dtype=np.uint8)
    for length in range(2, runs + 1):
        goes_on = first + length <= last[first]
        first, crc = first[goes_on], crc[goes_on]
        at = np.zeros(len(first), dtype=np.int64)
        crc = crc_feed(crc, b" ", space, at, at + 1)
        end = first + length - 1
        crc = crc_feed(crc, words.data, words.buf, words.starts[end], words.ends[end])
        found.append(crc)
        rows.append(owner[first])
    return np.concatenate(found).astype(np.int64) % buckets, np.concatenate(rows)


def _words(batch: pa.RecordBatch) -> Words:
    return Words([lower_ascii(utf8(t)) for t in texts_of(batch)], ALNUM_WORDS)


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket.  A task adds up its
    own counts, so at most ``buckets`` rows leave it or reach the driver."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch):
                total += np.bincount(bucketed_runs(_words(part), runs, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    counted = docs.select(docs["text"].alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket")
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed target share over its corpus share."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Seeded Gumbel noise of an id, in thousandths (a null id reads as an empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, text_key (a hash of the text) per row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(gain)     # one number a bucket

    def score(batches):
        for batch in batches:
            for part in text_slices(batch):
                words = _words(part)
                bucket, row = bucketed_runs(words, runs, len(held.value))
                n = part.num_rows
                features = np.bincount(row, minlength=n)
                total = np.zeros(n, dtype=np.int64)
                np.add.at(total, row, held.value[bucket])
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                extra = np.array([noise(i, seed) for i in part.column(0).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "n_words": pa.array(np.diff(words.doc_first), pa.int64()),
                    "n_features": pa.array(features, pa.int64()), "weight": pa.array(weight, pa.int64()),
                    "score": pa.array(weight + extra, pa.int64()), "text_key": part.column(2)})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"),
                       F.xxhash64(docs["text"]).alias("text_key"))
    return rows.mapInArrow(score, _ROW)


# --- LSD radix sort -------------------------------------------------------

def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` in blocks, in the order they are read in: _block, _pos."""
    place = F.monotonically_increasing_id()
    block = F.shiftright(place, _PLACE_BITS) * F.lit(1 << (_PLACE_BITS - 14)) + F.shiftright(
        place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)), 14)
    return rows.select("*", block.alias("_block"), place.bitwiseAND(F.lit((1 << 14) - 1)).alias("_pos"))


def _mover(base: np.ndarray, block_rows: int):
    """One counting-sort step of one block: rows in place order, stably by
    digit, each to its digit's base plus what earlier blocks hold of it."""

    def move(block: pa.Table, offsets: pa.Table) -> pa.Table:
        digit = block.column("_digit").to_numpy()
        order = np.lexsort((block.column("_pos").to_numpy(), digit))
        ordered = digit[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        local = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
        before = np.zeros(len(base), dtype=np.int64)
        before[offsets.column("_digit").to_numpy()] = offsets.column("_before").to_numpy()
        to = np.empty(len(order), dtype=np.int64)
        to[order] = base[ordered] + before[ordered] + local
        out = block.drop_columns(["_block", "_pos", "_digit"])
        return out.append_column("_block", pa.array(to // block_rows, pa.int64())).append_column("_pos", pa.array(to % block_rows, pa.int64()))

    return move


def radix_ranks(rows: DataFrame, keys: list[tuple], bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``rank`` = 1, 2, ... in the order of ``keys``, ties in the
    order the rows are read in.

    ``keys``: (column expression of a non-negative long, its largest value),
    most significant first.  Passes go from the last key's lowest digit to the
    first key's highest; a digit that all rows share needs no pass."""
    at = materialise(_placed(rows), "radix-0")
    plain = rows.columns
    total = at.count()
    step = 0
    for key, largest in reversed(keys):
        for shift in range(0, max(1, int(largest).bit_length()), bits):
            digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            counted = at.groupBy(F.col("_block"), digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
            base = np.zeros(1 << bits, dtype=np.int64)
            for r in counted.groupBy("_digit").agg(F.sum("_n").alias("n")).collect():     # a row a digit value
                base[r["_digit"]] = r["n"]
            if base.max() == total:
                continue
            base = np.cumsum(base) - base
            earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            offsets = counted.select("_block", "_digit", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            moved = (at.withColumn("_digit", digit).groupBy("_block").cogroup(offsets.groupBy("_block"))
                     .applyInArrow(_mover(base, block_rows), f"{fields}, _block long, _pos long"))
            step += 1
            at = materialise(moved, f"radix-{step}")
    if not step:        # one value of every key: the order the rows are read in
        counts = sorted((r["_block"], r["n"]) for r in at.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect())
        starts, before = [], 0
        for block, n in counts:
            starts.append((block, before))
            before += n
        firsts = at.sparkSession.createDataFrame(starts, "_block long, _first long")
        return at.join(firsts, "_block").select(*plain, (F.col("_first") + F.col("_pos") + 1).alias("rank"))
    return at.select(*plain, (F.col("_block") * block_rows + F.col("_pos") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             runs: int = RUNS, buckets: int = BUCKETS, bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank, text_key per row of ``docs``.

    Of the N rows with at least ``min_words`` words, the floor(percent * N /
    100) highest scores are drawn and ranked from 1; other rows have a null
    rank.  Ties go to the smaller doc_id, null ids after all others; rows that
    tie in both keep the order the table is read in.  Null and empty texts have
    no runs and weight 0.  Repeated rows are drawn row by row.  An empty target
    leaves smoothing alone; an empty table gives an empty result.  Other
    columns are not read."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = materialise(scored(docs, gain, runs, seed), "importance-scores")
    enough = F.col("n_words") >= min_words
    fits = rows.filter(enough)
    ends = fits.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                    F.min("score").alias("least"), F.max("score").alias("most")).first()
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    unranked = F.lit(None).cast("long").alias("rank")
    if not ends["n"]:
        return rows.select(*out, unranked, "text_key")
    low, high = ends["low"] or 0, ends["high"] or 0
    # ids as their distance from the smallest, counted without overflow in 64 bits
    place = F.coalesce(F.try_subtract(F.col("doc_id"), F.lit(low)) if high - low < 1 << 63 else F.col("doc_id").bitwiseXOR(F.lit(-1 << 63)), F.lit(0))
    keys = [(F.lit(ends["most"]) - F.col("score"), ends["most"] - ends["least"]),
            (F.col("doc_id").isNull().cast("long"), 1),
            (place, high - low if high - low < 1 << 63 else (1 << 64) - 1)]
    ranked = radix_ranks(fits, keys, bits, block_rows)
    drawn = F.col("rank") <= percent * ends["n"] // 100
    return (ranked.select(*out, F.when(drawn, F.col("rank")).alias("rank"), "text_key")
            .unionByName(rows.filter(~enough).select(*out, unranked, "text_key")))


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves: doc_id, text, weight, score, rank, one
    row a drawn row (options and odd input as for ``resample``).

    Ranks meet texts on (doc_id, hash of the text); rows equal in both are one
    row there, so a draw of several copies is not multiplied."""
    drawn = resample(docs, target, **options).filter("rank is not null")
    id_, text = docs["doc_id"].cast("long"), docs["text"]
    texts = docs.select(id_.alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text")).groupBy("_id", "_key").agg(F.min("text").alias("text"))
    same = drawn["doc_id"].eqNullSafe(texts["_id"]) & (drawn["text_key"] == texts["_key"])
    return drawn.join(texts, same).select("doc_id", "text", "weight", "score", "rank")
