"""Exact dedup with counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit
fingerprints of its texts: the fingerprint is split into a quotient (its
run) and a remainder, remainders are kept sorted within their run, a
remainder that comes more than once keeps a counter.  Filters are cut into
ranges of quotients, and the filters of all partitions merge range by range
by merging sorted remainders, adding counters: no information is lost.
Fingerprints whose merged count is above one route their documents to byte
verification, which groups by the bytes of the text themselves (after
partial aggregation, so a hot text is one row a task before the shuffle).

A filter holds one entry per distinct fingerprint of its partition, so its
size follows the partition, not the corpus; a range of the merged filter
holds about ``range_entries`` entries at any corpus size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

QUOTIENT_BITS = 20
_REM_BITS = 64 - QUOTIENT_BITS
_REM_MASK = np.uint64((1 << _REM_BITS) - 1)


class CountingQuotientFilter:
    """Counting quotient filter of 64-bit fingerprints over a range of
    quotients ``[low, low + size)``.

    Slots hold remainders, sorted within the run of their quotient.
    ``occupied`` says which quotients have a run, ``run_ends`` which slot is
    the last of its run, and ``counted`` which slots have a counter above
    one (counters follow in slot order).
    """

    def __init__(self, low: int, size: int, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: sorted, distinct; counts: one per fingerprint."""
        self.low, self.size = low, size
        quotient = (fingerprints >> np.uint64(_REM_BITS)).astype(np.int64) - low
        self.remainders = fingerprints & _REM_MASK
        self.occupied = np.zeros(size, dtype=bool)
        self.occupied[quotient] = True
        n = len(fingerprints)
        self.run_ends = np.ones(n, dtype=bool)
        if n:
            self.run_ends[:-1] = quotient[1:] != quotient[:-1]
        self.counted = counts > 1
        self.counters = counts[self.counted].astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, counts), sorted: the filter read back losslessly."""
        n = len(self.remainders)
        run = np.zeros(n, dtype=np.int64)
        if n:
            run[1:] = np.cumsum(self.run_ends[:-1])
        quotient = np.flatnonzero(self.occupied)[run] + self.low
        counts = np.ones(n, dtype=np.int64)
        counts[self.counted] = self.counters
        return (quotient.astype(np.uint64) << np.uint64(_REM_BITS)) | self.remainders, counts

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        """The filter of both inputs: sorted remainders merged, counts added."""
        (a, na), (b, nb) = self.entries(), other.entries()
        return CountingQuotientFilter(self.low, self.size, *sum_sorted(np.concatenate([a, b]), np.concatenate([na, nb])))

    def to_bytes(self) -> bytes:
        """Header, occupied bits, run-end bits, counted bits, remainders
        (``_REM_BITS`` rounded up to whole bytes), counters."""
        width = (_REM_BITS + 7) // 8
        rem = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.low, self.size, len(self.remainders), len(self.counters)], dtype="<i8")
        return b"".join((head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(),
                         np.packbits(self.counted).tobytes(), rem.tobytes(), self.counters.astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountingQuotientFilter":
        width = (_REM_BITS + 7) // 8
        low, size, n, m = (int(x) for x in np.frombuffer(raw, dtype="<i8", count=4))
        at = 32

        def bits(count: int) -> np.ndarray:
            nonlocal at
            length = (count + 7) // 8
            out = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=at, count=length), count=count).astype(bool)
            at += length
            return out

        f = cls.__new__(cls)
        f.low, f.size = low, size
        f.occupied, f.run_ends, f.counted = bits(size), bits(n), bits(n)
        rem = np.zeros((n, 8), dtype=np.uint8)
        rem[:, :width] = np.frombuffer(raw, dtype=np.uint8, offset=at, count=n * width).reshape(n, width)
        at += n * width
        f.remainders = rem.reshape(-1).view("<u8").astype(np.uint64)
        f.counters = np.frombuffer(raw, dtype="<i8", offset=at, count=m).astype(np.int64)
        return f


def sum_sorted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the counts of equal ones added."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts, first)


def build_filters(fingerprints: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """A partition's filter, cut into ``ranges`` ranges of quotients."""
    values, counts = sum_sorted(fingerprints, np.ones(len(fingerprints), dtype=np.int64))
    size = (1 << QUOTIENT_BITS) // ranges
    which = ((values >> np.uint64(_REM_BITS)) // np.uint64(size)).astype(np.int64)
    edges = np.searchsorted(which, np.arange(ranges + 1))
    for r in np.unique(which):
        lo, hi = edges[r], edges[r + 1]
        yield int(r), CountingQuotientFilter(int(r) * size, size, values[lo:hi], counts[lo:hi]).to_bytes()


def repeated_fingerprints(prints: DataFrame, column: str, ranges: int) -> DataFrame:
    """(fingerprint): those that come more than once in ``prints``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0)).astype(np.int64).view(np.uint64) for b in batches]
        made = list(build_filters(np.concatenate(parts), ranges)) if parts else []
        if made:
            yield pa.RecordBatch.from_pydict({"part": pa.array([r for r, _ in made], pa.int32()),
                                              "filter": pa.array([f for _, f in made], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
        while len(filters) > 1:   # pairwise, so that each entry is moved log(filters) times
            filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i]
                       for i in range(0, len(filters), 2)]
        values, counts = filters[0].entries()
        return pa.table({"fp": pa.array(values[counts > 1].view(np.int64), pa.int64())})

    built = prints.select(F.col(column)).mapInArrow(build, "part int, filter binary")
    return built.groupBy("part").applyInArrow(merge, "fp long")


def quotient_ranges(rows: int, range_entries: int) -> int:
    """Number of quotient ranges: a power of two, about range_entries each."""
    return 1 << min(QUOTIENT_BITS, max(3, math.ceil(math.log2(max(1, rows) / range_entries + 1))))


def exact_duplicates(docs: DataFrame, range_entries: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, copies.

    * Texts are equal when identical after no change; null counts as empty,
      and null and empty texts are one group.
    * Of equal texts, the row with the largest doc_id stays (null ids are
      smaller than any other; a group of null ids only keeps null).
    * Rows that repeat both doc_id and text are one document: returned once,
      with their number in ``copies``; ``group_size`` counts every row.
    * An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    narrow = materialise(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"),
        F.xxhash64(text).alias("fp")), "exact-prints")
    ranges = quotient_ranges(narrow.count(), range_entries)
    repeated = materialise(repeated_fingerprints(narrow, "fp", ranges), "exact-repeated")

    # byte verification: documents of repeated fingerprints, grouped by their bytes
    fp = free_name(docs, "fp")
    suspects = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias(fp))
    suspects = suspects.join(repeated.withColumnRenamed("fp", fp), fp, "left_semi")
    classes = (suspects.groupBy(fp, "text")
               .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .filter("group_size > 1")
               .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    classes = materialise(classes, "exact-classes")

    ids = narrow.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    out = ids.join(classes, "text_sha256", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"),
                      F.when(grouped, F.col("group_size")).otherwise(F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "copies")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay; null texts stay null."""
    decided = exact_duplicates(docs).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("copies").alias("_copies"))
    return keep_rows(docs, decided, F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def keep_rows(docs: DataFrame, decided: DataFrame, sha) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, sha) is in ``decided`` (_id, _sha,
    _copies); of rows that repeat both, one stays."""
    decided = materialise(decided, "kept-rows")
    key = free_name(docs, "row_sha")
    keyed = docs.withColumn(key, sha)
    hit = keyed["doc_id"].cast("long").eqNullSafe(decided["_id"]) & (keyed[key] == decided["_sha"])
    kept = keyed.join(decided.filter("_copies = 1"), hit, "left_semi").drop(key)
    repeated = decided.filter("_copies > 1")
    if repeated.isEmpty():
        return kept
    again = keyed.join(repeated, hit, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(again)
