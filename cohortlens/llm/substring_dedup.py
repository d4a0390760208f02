"""Substring dedup with prefix-partitioned suffix trees.

A passage repeats when a window of ``window`` words also starts in a
document with a smaller id.  Most windows repeat nothing, so they are sieved
first: every window picks the smallest hash among its runs of ``RUN`` words
(equal windows pick the same run), and only windows whose run occurs in two
documents go on.  The sieve loses no repeat; the subtrees decide.

Neighbouring windows that pick the same run overlap in all but a word each, so
they travel as one segment: every word code once.  The run is the prefix that
sends a segment to its group; a run with more windows than a group may hold
takes the longest prefix, the whole window, instead.  A group sorts the
suffixes of its segments; neighbours that share a whole window are one node of
that depth, with the smallest document below it.  Stretches of repeated windows
that touch are one repeat, so a document's spans are maximal
(``repeated_spans``).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, map_batches, materialise, text_slices, texts_of
from .wordarrays import SPACE_WORDS, Words, mix, run_hash, utf8

WINDOW = 13
RUN = 4
GROUP_SUFFIXES = 1 << 18
CODE = 6               # bytes of a word's code
CELLS = 1 << 14        # cells of runs that are counted to form groups
SEGMENT = 60           # windows of a segment at most, a bit each
_NEVER = (1 << 63) - 1
_U = np.uint64


class Scan:
    """Words of a batch of documents and their windows.

    ``start``: word index of every window; ``doc``: its row in the batch;
    ``run``: hash of the word run the window picks."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = Words([utf8(t) for t in texts], SPACE_WORDS)
        self.codes = self.words.fingerprints() >> _U(64 - 8 * CODE)
        n, first = len(self.codes), self.words.doc_first
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        run = min(RUN, window)
        valid = np.arange(n) + window <= first[1:][owner] if n else np.zeros(0, dtype=bool)
        self.start = np.flatnonzero(valid)
        self.doc = owner[self.start]
        self.run = sliding_min(run_hash(self.codes, run), window - run + 1)[self.start]
        self.window = window

    @cached_property
    def whole(self) -> np.ndarray:
        """Hash of every window."""
        return run_hash(self.codes, self.window)[self.start]

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, size): neighbouring windows of a document that pick the same run."""
        new = np.ones(len(self.run), dtype=bool)
        new[1:] = (self.run[1:] != self.run[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(self.run)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Entry i: the smallest of ``x[i:i + width]`` (near the end: of what is
    left), from minima over widths that double."""
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[:-step] = np.minimum(out[:-step], out[step:])
        span += step
    return out


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _low_high(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, smallest and largest id of each."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, order, ids, ids
    return keys[first], order[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _nodes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """(run): picked runs that occur in two documents or more."""

    def pick(batch: pa.RecordBatch) -> dict:
        scan = Scan(texts_of(batch), window)
        first, _ = scan.picks()
        run, _, low, high = _low_high(scan.run[first], _ids(batch)[scan.doc[first]])
        return {"run": _long(run), "low": _long(low), "high": _long(high)}

    found = map_batches(docs, pick, "run long, low long, high long").groupBy("run")
    return found.agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("run")


def with_hashes(docs: DataFrame, occurrences: DataFrame, column: str) -> DataFrame:
    """``docs`` that have occurrences (node, column), with those as an array."""
    listed = occurrences.groupBy("node").agg(F.collect_set(column).alias(column))
    return docs.join(listed, "node")


class Groups:
    """Which group a window belongs to: that of its run's cell, cells put
    together up to ``limit`` windows, or, where the cell alone holds more, one
    of the groups below 0 by the whole window."""

    def __init__(self, histogram: np.ndarray, limit: int):
        self.cells = len(histogram)
        self.hot = histogram > limit
        self.group = np.cumsum(np.where(self.hot, 0, histogram)) // limit
        self.spread = max(1, 2 * int(histogram[self.hot].sum()) // limit)

    def of(self, run: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, is the run's cell too full?) of every window."""
        cell = (run % _U(self.cells)).astype(np.int64)
        alone = -1 - (mix(whole) % _U(self.spread)).astype(np.int64)
        return np.where(self.hot[cell], alone, self.group[cell]), self.hot[cell]


def segments(scan: Scan, at: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows ``at`` (ascending) as segments: (first entry of each, windows in
    it).  Windows go together when they follow each other in a document and pick
    the same run; ``single`` ones stay alone."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, run, doc = scan.start[at], scan.run[at], scan.doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (run[1:] != run[:-1]) | (doc[1:] != doc[:-1]) | single[1:] | single[:-1]
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % SEGMENT == 0)
    return first, np.diff(np.append(first, len(at)))


def segment_hash(whole: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each segment from those of its windows (and their places)."""
    if not len(first):
        return np.empty(0, np.uint64)
    inside = np.arange(len(whole)) - np.repeat(first, n)
    return np.add.reduceat(mix(whole + inside.astype(np.uint64)), first)


def packed_columns(codes: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """The ``window`` codes from each ``start`` on as few 64-bit columns: codes are
    numbered in their order, as many numbers go into a column as fit.  Rows
    compare as the codes do."""
    known, number = np.unique(codes, return_inverse=True)
    number = number.astype(np.uint64)
    bits = max(1, (len(known) - 1).bit_length())
    each = max(1, 64 // bits)
    out = np.empty((-(-window // each), len(start)), dtype=np.uint64)
    for row, lo in enumerate(range(0, window, each)):
        out[row] = number[start + lo]
        for k in range(lo + 1, min(window, lo + each)):
            out[row] = out[row] << _U(bits) | number[start + k]
    return out


def subtree_repeats(suffixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The subtree over ``suffixes`` (``packed_columns``, a column a suffix): for
    each, the smallest document below its internal node of window depth, or
    ``_NEVER`` where there is one document only."""
    out = np.full(suffixes.shape[1], _NEVER, dtype=np.int64)
    if not len(out):
        return out
    order = np.lexsort(suffixes[::-1])
    # a node of full depth is a run of neighbours that share all words
    differ = np.zeros(len(out), dtype=bool)
    differ[0] = True
    for column in suffixes:
        ordered = column[order]
        differ[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(differ)
    smallest, largest = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
    out[order] = np.repeat(np.where(smallest < largest, smallest, _NEVER), np.diff(np.append(first, len(order))))
    return out


def build_subtree(window: int):
    """Group function: segments (codes, low, high) to (seg, head, lows): the
    smallest document of each window, for segments with a repeated one."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table.column("codes").combine_chunks()
        size = pc.binary_length(rows).to_numpy(zero_copy_only=False).astype(np.int64) // CODE
        flat = np.frombuffer(b"".join(rows.to_pylist()), dtype=np.uint8).reshape(-1, CODE)
        codes = np.zeros((len(flat), 8), dtype=np.uint8)
        codes[:, :CODE] = flat
        codes = codes.view("<u8").reshape(-1)
        n = size - window + 1
        owner, first = np.repeat(np.arange(len(rows)), n), np.cumsum(n) - n
        start = np.repeat(np.cumsum(size) - size - first, n) + np.arange(n.sum())
        suffixes = packed_columns(codes, start, window)
        lows = subtree_repeats(suffixes, table.column("low").to_numpy()[owner], table.column("high").to_numpy()[owner])
        whole = run_hash(codes, window)[start]
        seg, head = segment_hash(whole, first, n), whole[first]
        # the same segment from several slices has the same windows: once
        order = np.lexsort((head, seg))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (seg[order[1:]] != seg[order[:-1]]) | (head[order[1:]] != head[order[:-1]])
        once = np.sort(order[new])
        once = once[np.minimum.reduceat(lows, first)[once] != _NEVER]
        kept = np.zeros(len(rows), dtype=bool)
        kept[once] = True
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[once]))).astype(np.int32)), pa.array(lows[kept[owner]]))
        return pa.table({"seg": _long(seg[once]), "head": _long(head[once]), "lows": lists})

    return build


class Sieve:
    """Segments of a batch of marked documents (id, text, run, node).

    ``at``: windows that pick a repeated run; ``first``, ``n``: the segments
    over them; ``begin``: word each starts at; ``seg``, ``head``: their hashes."""

    def __init__(self, batch: pa.RecordBatch, window: int, groups: Groups | None = None):
        self.scan = scan = Scan(texts_of(batch), window)
        runs = batch.column(batch.schema.get_field_index("run"))
        listed = runs.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        keys = np.unique(mix(listed ^ mix(owner.astype(np.uint64) + _U(1))))
        first, size = scan.picks()
        marked = np.isin(mix(scan.run[first] ^ mix(scan.doc[first].astype(np.uint64) + _U(1))), keys)
        self.at = np.flatnonzero(np.repeat(marked, size))
        if groups is None:
            return
        whole = scan.whole[self.at]
        group, single = groups.of(scan.run[self.at], whole)
        self.first, self.n = segments(scan, self.at, single)
        self.group = group[self.first]
        self.doc = scan.doc[self.at[self.first]]
        self.begin = scan.start[self.at[self.first]]
        self.seg, self.head = segment_hash(whole, self.first, self.n), whole[self.first]


def plan_groups(marked: DataFrame, window: int, limit: int) -> Groups:
    """Groups of at most about ``limit`` windows, from their counts by cell of
    the run.  A task adds up its own counts, so at most ``CELLS`` rows leave it."""

    def count(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch):
                found = Sieve(part, window)
                total += np.bincount((found.scan.run[found.at] % _U(CELLS)).astype(np.int64), minlength=CELLS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": _long(held), "n": _long(total[held])})

    histogram = np.zeros(CELLS, dtype=np.int64)
    for r in marked.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        histogram[r["cell"]] = r["n"]
    return Groups(histogram, limit)


def repeated_segments(marked: DataFrame, window: int, groups) -> DataFrame:
    """(seg, head, lows): segments with repeated windows and the smallest
    document each of their windows starts in.  ``groups``: broadcast."""

    def emit(batch: pa.RecordBatch) -> dict:
        found = Sieve(batch, window, groups.value)
        # equal segments of the slice go once, with their smallest and largest id
        _, place, low, high = _low_high(mix(found.seg) ^ found.head, _ids(batch)[found.doc])
        codes = found.scan.codes
        raw = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes() if len(codes) else b""
        begin = found.begin[place]
        end = begin + found.n[place] + window - 1
        return {"group": _long(found.group[place]), "codes": pa.array([raw[CODE * b:CODE * e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary()),
                "low": _long(low), "high": _long(high)}

    rows = map_batches(marked, emit, "group long, codes binary, low long, high long")
    return rows.groupBy("group").applyInArrow(build_subtree(window), "seg long, head long, lows array<long>")


def marked_documents(docs: DataFrame, window: int) -> DataFrame:
    """id, text, run, node of the documents that hold repeated runs, written."""
    runs = materialise(repeated_runs(docs, window), "substring-runs")

    def picked(batch: pa.RecordBatch) -> dict:
        scan = Scan(texts_of(batch), window)
        first, _ = scan.picks()
        run, node = _distinct_pairs(scan.run[first], _nodes(batch)[scan.doc[first]])
        return {"run": _long(run), "node": _long(node)}

    seen = map_batches(docs, picked, "run long, node long").join(runs, "run", "left_semi")
    marked = materialise(with_hashes(docs, seen, "run").select("id", "text", "run", "node"), "substring-marked")
    let_go(docs.sparkSession, runs)
    return marked


def covered_words(docs: DataFrame, window: int = WINDOW, limit: int = GROUP_SUFFIXES) -> DataFrame:
    """``docs`` (id, text, node) with ``windows``: array of (start, mask), the
    windows start + i, for each bit i of the mask, that also start in a document
    with a smaller id (null: none).  ``node`` is the same for rows equal in id and
    text only, so what is gathered for a node and joined back to its rows is as
    long as that one text."""
    spark = docs.sparkSession
    marked = marked_documents(docs, window)
    let_go(spark)
    groups = spark.sparkContext.broadcast(plan_groups(marked, window, limit))
    repeats = materialise(repeated_segments(marked, window, groups), "substring-repeats")
    let_go(spark)

    def places(batch: pa.RecordBatch) -> dict:
        found = Sieve(batch, window, groups.value)
        begin = found.begin - found.scan.words.doc_first[found.doc]
        return {"seg": _long(found.seg), "head": _long(found.head), "id": _long(_ids(batch)[found.doc]), "node": _long(_nodes(batch)[found.doc]),
                "start": _long(begin)}

    bits = F.transform("lows", lambda low, i: F.when(low < F.col("id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0)))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    later = (map_batches(marked, places, "seg long, head long, id long, node long, start long").join(repeats, ["seg", "head"])
             .select("node", F.struct("start", mask.alias("mask")).alias("at")).filter("at.mask <> 0")
             .groupBy("node").agg(F.collect_set("at").alias("windows")))
    later = materialise(later, "substring-covered")
    let_go(spark, marked, repeats)
    return docs.join(later, "node", "left")


def _removed(batch: pa.RecordBatch, window: int) -> tuple[Words, np.ndarray]:
    """Words of the batch, and which of them a repeated window covers."""
    words = Words([utf8(t) for t in texts_of(batch)], SPACE_WORDS)
    edge = np.zeros(len(words) + window + 1, dtype=np.int64)
    listed = batch.column(batch.schema.get_field_index("windows"))
    sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    found = listed.flatten()
    start = found.field(0).to_numpy(zero_copy_only=False) + np.repeat(words.doc_first[:-1], sizes)
    mask = found.field(1).to_numpy(zero_copy_only=False)
    bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    at = start[row] + bit
    edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + window, minlength=len(edge))
    return words, np.cumsum(edge)[:len(words)] > 0


def _kept(words: Words, gone: np.ndarray) -> pa.Array:
    """Text of every document from the words that stay, one space apart: the bytes of
    those words, and the one after each but a document's last, as a space."""
    stay = np.flatnonzero(~gone)
    starts, ends = words.starts[stay], words.ends[stay]
    first = np.searchsorted(stay, words.doc_first)
    spaced = np.ones(len(stay), dtype=bool)
    spaced[first[1:][np.diff(first) > 0] - 1] = False
    edge = np.zeros(len(words.buf) + 2, dtype=np.int8)
    edge[starts] = 1
    edge[ends + spaced] -= 1            # a word may start where the space before it ends
    out = words.buf.copy()
    out[ends[spaced]] = 0x20
    out = out[np.cumsum(edge, dtype=np.int8)[:len(out)].view(bool)]
    offsets = np.concatenate(([0], np.cumsum(ends - starts + spaced)))[first]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


_LAST = (1 << 63) - 1       # null ids come after all others


def _narrow(docs: DataFrame) -> DataFrame:
    id_ = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))
    return docs.select(id_.alias("id"), docs["text"].alias("text"), F.xxhash64(id_, docs["text"]).alias("node"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, limit: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, start, length: every maximal stretch of words covered by windows
    that also start in a document with a smaller id, a row a stretch (nulls,
    repeats and empty tables as in ``remove_repeats``)."""

    def spans(batch: pa.RecordBatch) -> dict:
        words, gone = _removed(batch, window)
        ids, out = _ids(batch), ([], [], [])
        for row, (lo, hi) in enumerate(zip(words.doc_first[:-1].tolist(), words.doc_first[1:].tolist())):
            edge = np.diff(np.concatenate(([0], gone[lo:hi].astype(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for column, values in zip(out, (np.full(len(begin), ids[row]), begin, end - begin)):
                column.append(values)
        return {c: _long(np.concatenate(v) if v else np.empty(0, np.int64)) for c, v in zip(("doc_id", "start", "length"), out)}

    marked = covered_words(_narrow(docs), window, limit).filter("windows is not null").select("id", "text", "windows")
    return map_batches(marked, spans, "doc_id long, start long, length long").withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, limit: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words, one space apart) per
    row of ``docs``.

    Null and empty texts have no words.  Documents of fewer words than a
    window lose nothing.  Rows that repeat a doc_id are one document to each
    other: neither makes the other lose words.  Null ids come after all
    others.  An empty table gives no rows; other columns are not read."""
    def cut(batch: pa.RecordBatch) -> dict:
        words, gone = _removed(batch, window)
        first = words.doc_first
        n = np.diff(first)
        total = np.concatenate(([0], np.cumsum(gone)))
        return {"doc_id": batch.column(0), "n_words": _long(n), "n_removed": _long(total[first[1:]] - total[first[:-1]]),
                "kept_text": _kept(words, gone)}

    marked = covered_words(_narrow(docs), window, limit).select("id", "text", "windows")
    out = map_batches(marked, cut, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))
