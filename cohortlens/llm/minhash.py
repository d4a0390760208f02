"""Document fingerprints by MinHash.

A text's shingles are its runs of five words (lower-cased A-Z); a shorter
text is one shingle.  ``PERMUTATIONS`` universal hash functions
``(a * x + b) mod 2^64 >> 32`` go over a batch's shingles at once in numpy;
a signature holds the smallest value of each.  The fingerprint keeps the
lowest byte of every minimum, which agree by chance once in 256; ``likeness``
takes that chance out.

``near_links`` finds near copies: signatures are cut into bands, bands of
different texts are joined in Spark, and the Jaccard similarity of the
shingle sets themselves decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_batches, materialise, text_slices, texts_of
from .components import components
from .wordarrays import SPACE_WORDS, Words, lower_ascii, run_hash, utf8

SHINGLE = 5
PERMUTATIONS = 128
SEED = 11
BANDS, ROWS = 25, 5          # a pair of similarity 0.8 shares no band once in 20,000
THRESHOLD = 0.8
_U = np.uint64
_STEP = 1 << 15


def _family(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    high = np.iinfo(np.uint64).max
    return rng.integers(0, high, k, dtype=np.uint64, endpoint=True) | _U(1), rng.integers(0, high, k, dtype=np.uint64, endpoint=True)


def shingle_hashes(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes of all shingles, first entry of each text and the end)."""
    words = Words([lower_ascii(utf8(t)) for t in texts], SPACE_WORDS)
    codes, first = words.fingerprints(), words.doc_first
    n = np.diff(first)
    long_runs = run_hash(codes, shingle)
    counts = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(at[-1], dtype=np.uint64)
    whole = np.repeat(n >= shingle, counts)
    place = np.arange(at[-1]) - np.repeat(at[:-1], counts) + np.repeat(first[:-1], counts)
    out[whole] = long_runs[place[whole]]
    for d in np.flatnonzero((n > 0) & (n < shingle)):
        out[at[d]] = run_hash(codes[first[d]:first[d + 1]], int(n[d]))[0]
    return out >> _U(32), at


def signatures(texts: list[str | None], permutations: int = PERMUTATIONS, seed: int = SEED, shingle: int = SHINGLE) -> np.ndarray:
    """One row of ``permutations`` 32-bit minima a text; a text without words has the largest value everywhere."""
    x, at = shingle_hashes(texts, shingle)
    a, b = _family(permutations, seed)
    out = np.full((len(texts), permutations), 0xFFFFFFFF, dtype=np.uint32)
    held = np.flatnonzero(np.diff(at))
    # stretches of whole texts that stay in the processor's cache; a longer text is a stretch of its own
    lo = 0
    while lo < len(held):
        hi = max(lo + 1, int(np.searchsorted(at[held], at[held[lo]] + _STEP)))
        rows = held[lo:hi]
        base = at[rows[0]]
        part, firsts = x[base:at[rows[-1] + 1]], at[rows] - base
        for k in range(permutations):
            out[rows, k] = np.minimum.reduceat((part * a[k] + b[k]) >> _U(32), firsts)
        lo = hi
    return out


def fingerprints(texts: list[str | None], permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """One row of ``permutations`` bytes a text."""
    return (signatures(texts, permutations, seed) & np.uint32(255)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row, 0 to 1."""
    agree = (a == b).mean(axis=1) if len(a) else np.empty(0)
    return np.clip((agree - 1 / 256) / (1 - 1 / 256), 0, 1)


def fingerprint_documents(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``fingerprint`` (hex; under another name if taken).  Null
    texts are empty; equal texts have equal fingerprints."""
    name = free_name(docs, "fingerprint")

    def mark(batch: pa.RecordBatch) -> dict:
        marks = fingerprints(texts_of(batch), permutations, seed)
        return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {name: pa.array([m.tobytes().hex() for m in marks], pa.string())}

    return map_batches(docs, mark, docs.select("*", F.lit("").alias(name)).schema)


# --- each document against its edited text and its follower ------------------

def edited_text(text: str, follower: str) -> str:
    """``text`` whose last quarter of code points gives way to as many of the follower's first."""
    n = len(text) // 4
    return text[:len(text) - n] + follower[:n]


_PAIR = ("kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
         "near_edited double, near_next double, text string")
_DONE, _FIRST, _LAST = 0, 1, 2


def _judge(ids: list, texts: list[str], after: list[str], permutations: int, seed: int) -> dict:
    edited = [edited_text(t, f) for t, f in zip(texts, after)]
    # texts follow each other, so the follower's marks are those of the next row; only the last follower is new
    own = fingerprints([*texts, after[-1]], permutations, seed) if texts else np.empty((0, permutations), np.uint8)
    new = fingerprints(edited, permutations, seed)
    n = len(texts)
    return {"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(utf8(e)).hexdigest() for e in edited], pa.string()),
            "fingerprint": pa.array([m.tobytes() for m in own[:n]], pa.binary()),
            "edited_fingerprint": pa.array([m.tobytes() for m in new], pa.binary()),
            "near_edited": pa.array(likeness(own[:n], new), pa.float64()),
            "near_next": pa.array(likeness(own[:n], own[1:]), pa.float64())}


def compare_with_next(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next per row of ``docs``.

    Documents follow each other by ascending doc_id, null ids last; rows that
    repeat an id follow by a hash of their text, then of their place in the
    table, and the last document is followed by the first.  Null texts are
    empty.  One document alone follows itself.  An empty table gives an empty
    result; other columns are not read.

    Texts are shuffled once, by ranges of the order.  A task streams its range
    and knows every follower but its last row's; the first and last row of each
    range (two texts a range) are matched afterwards."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("_text").asc(), F.col("_place").asc()]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.xxhash64(F.monotonically_increasing_id()).alias("_place"))
    ranged = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("doc_id", "text", F.spark_partition_id().alias("part")))

    def lone(kind: int, part: int, doc_id, text: str) -> pa.RecordBatch:
        values = {"kind": kind, "part": part, "doc_id": doc_id, "text": text}
        return pa.RecordBatch.from_pylist([values], schema=out_schema)

    out_schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                            ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                            ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])

    def run(batches):
        held = None                    # the row whose follower has not come yet
        for batch in batches:
            for piece in text_slices(batch):
                ids, texts, part = piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2)[0].as_py()
                if held is None:
                    yield lone(_FIRST, part, ids[0], texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1], part)
                if len(texts) > 1:
                    n = len(texts) - 1
                    cols = _judge(ids[:-1], texts[:-1], texts[1:], permutations, seed)
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([_DONE] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()),
                                                      **cols, "text": pa.nulls(n, pa.string())}, schema=out_schema)
        if held is not None:
            yield lone(_LAST, held[2], held[0], held[1])

    found = materialise(ranged.mapInArrow(run, _PAIR), "minhash-ranges")
    firsts = found.filter(F.col("kind") == _FIRST).select("part")
    # next range that has rows, the first one after the last: one number a range
    parts = sorted(r["part"] for r in firsts.collect())
    following = docs.sparkSession.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, after int")
    lasts = found.filter(F.col("kind") == _LAST).select("part", "doc_id", "text").join(following, "part")
    heads = found.filter(F.col("kind") == _FIRST).select(F.col("part").alias("after"), F.col("text").alias("follower"))

    def close(batch: pa.RecordBatch) -> dict:
        rows = [_judge([i], [t], [f], permutations, seed) for i, t, f in
                zip(*(batch.column(k).to_pylist() for k in range(3)))]
        return {c: pa.concat_arrays([r[c] for r in rows]) for c in rows[0]} if rows else None

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    edge = map_batches(lasts.join(heads, "after").select("doc_id", "text", "follower"), close,
                       "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
                       "near_edited double, near_next double")
    out = found.filter(F.col("kind") == _DONE).select(*columns).unionByName(edge)
    return out.select(*[F.lower(F.hex(c)).alias(c) if c.endswith("fingerprint") else F.col(c) for c in columns])


# --- near copies ------------------------------------------------------------

def near_links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(a, b, jaccard): links of similarity ``threshold`` or more between
    different texts, each text by its smallest doc_id (rows without id have no
    part in it), a < b.

    Equal texts are one node.  The members of a band bucket meet the bucket's
    smallest member, not each other; those that fail there go on to a next
    round of the bucket with a smallest member of their own, until none is
    left, so every member is verified against a member it shares a band with
    and no bucket gives all its pairs.  Two members that hang on the same node
    are not listed as a link again.  Texts without words are one node without
    links.  An empty table: an empty result."""
    keep = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    nodes = materialise(keep.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("id"), F.first("text").alias("text")).drop("sha"), "minhash-nodes")

    def banded(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        marks = signatures(texts, bands * rows, seed)
        ids = np.repeat(batch.column(0).to_numpy(), bands)
        keys = [hashlib.blake2b(marks[d, k * rows:(k + 1) * rows].tobytes() + bytes([k]), digest_size=8).digest()
                for d in range(len(texts)) for k in range(bands)]
        some = np.repeat((marks != 0xFFFFFFFF).any(axis=1), bands)
        return {"bucket": pa.array(np.frombuffer(b"".join(keys), dtype="<i8")[some]), "id": pa.array(ids[some])}

    todo = materialise(map_batches(nodes, banded, "bucket long, id long"), "minhash-bands")

    def compared(batch: pa.RecordBatch) -> dict:
        a, b, left, right = (batch.column(k).to_pylist() for k in range(4))
        out = []
        for t, u in zip(left, right):
            x, y = (np.unique(shingle_hashes([v])[0]) for v in (t, u))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(out, pa.float64())}

    links = None
    while True:
        lead = todo.groupBy("bucket").agg(F.min("id").alias("a"))
        pairs = todo.join(lead, "bucket").filter("id > a").select("bucket", "a", F.col("id").alias("b"))
        distinct = pairs.select("a", "b").distinct()
        texts = distinct.join(nodes.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        texts = texts.join(nodes.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
        met = materialise(map_batches(texts.select("a", "b", F.col("left").alias("text"), "right"), compared, "a long, b long, jaccard double"), "minhash-met")
        good = met.filter(F.col("jaccard") >= threshold)
        links = good if links is None else links.unionByName(good)
        failed = pairs.join(met.filter(F.col("jaccard") < threshold), ["a", "b"]).select("bucket", F.col("b").alias("id"))
        todo = materialise(failed, "minhash-rest")
        if todo.isEmpty():
            return links.distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id reachable over links and equal texts) per row of ``docs``; null ids stay alone (null)."""
    links = materialise(near_links(docs, threshold), "minhash-links")
    found = components(links.select("a", "b"), "minhash-classes")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), sha.alias("sha"))
    leads = rows.groupBy("sha").agg(F.min("doc_id").alias("node"))
    named = leads.join(found, "node", "left").select("sha", F.coalesce("component", "node").alias("class_id"))
    return rows.join(named, "sha").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
