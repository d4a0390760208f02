"""SimHash near-dedup by the generalised pigeonhole principle.

Each text gets a 64-bit fingerprint (bitwise majority of the XXH64 hashes of
its word shingles).  Two different fingerprints within ``max_bits`` bits are
found by candidate keys instead of by comparing all pairs:

* correlated bits are grouped into the same partition (correlations come
  from a bounded sample; they steer cost only);
* for every fingerprint a dynamic program splits ``max_bits + 1`` over the
  partitions (a threshold of -1 leaves a partition out, t >= 0 probes every
  key within t bits of its own) at the least estimated number of candidates.
  By the generalised pigeonhole principle a neighbour within ``max_bits``
  lies within the threshold of at least one partition, whatever the split;
* the estimates come from a histogram of all distinct fingerprints over the
  first 16 bits of each partition (at most 65,536 cells a partition, so its
  size does not depend on the corpus);
* keys whose estimate is high are refined: the other bits are split into
  ``max_bits + 1`` blocks, one of which must agree, and the key takes the
  block's value, so no key gathers an unbounded group.

Candidates are verified in the tasks that hold a key; a task returns a
spanning forest of the links it found, not the pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_of, map_batches, materialise, sized, texts_of
from .components import components
from .exact_dedup import keep_rows
from .wordarrays import lower_ascii, mix, utf8

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SAMPLE = 20_000            # fingerprints the bit correlations are estimated from
HOT_KEY = 4_096            # estimated rows from which a key is refined
KEYS_PER_TASK = 400_000
_HIST = 16                 # bits of a partition that its histogram sees
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_U = np.uint64


# ---- fingerprints ---------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority fingerprint: a bit is 1 if set in over half of the hashes."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = [w for w in lower_ascii(utf8(text)).translate(_SPACES).split(b" ") if w]
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for k in range(0, n, 100_000):       # long texts a stretch at a time
        part = words[k:min(n, k + 100_000) + shingle - 1]
        hashes = [digest(b" ".join(s), seed) for s in zip(*(part[j:] for j in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), text_hash."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], dtype=np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64)), "text_hash": batch.column(2)}

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"),
                         F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"))
    return map_batches(source, run, "doc_id long, fp long, text_hash long")


# ---- partitions and thresholds --------------------------------------------

def bit_partitions(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of about equal width, correlated bits
    together: each group starts from the most correlated free bit and takes
    the bits that go with it most."""
    if len(sample) > 1:
        bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & _U(1)).astype(np.float64)
        spread = bits.std(axis=0)
        bits = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
        corr = np.abs(bits.T @ bits) / len(sample)
    else:
        corr = np.eye(64)
    free, out = list(range(64)), []
    for p in range(parts, 0, -1):
        width = math.ceil(len(free) / p)
        group = [max(free, key=lambda b: (corr[b][free].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (corr[b][group].sum(), -b)))
        free = [b for b in free if b not in group]
        out.append(group)
    return out


def gather_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed in that order."""
    out = np.zeros(len(fps), dtype=np.uint64)
    for at, b in enumerate(bits):
        out |= ((fps >> _U(b)) & _U(1)) << _U(at)
    return out


class Allocation:
    """Candidate estimates, thresholds and keys for one set of fingerprints."""

    def __init__(self, partitions: list[list[int]], histogram: np.ndarray, max_bits: int):
        self.partitions, self.max_bits = partitions, max_bits
        cells = np.arange(1 << _HIST)
        self.estimate = []      # per partition: candidates within 0, 1, 2 bits, by histogram cell
        self.probes = []        # per partition: number of keys within 0, 1, 2 bits
        for part, counts in zip(partitions, histogram):
            inner = min(_HIST, len(part))
            outer = len(part) - inner
            h = counts / float(1 << outer)
            one = sum(h[cells ^ (1 << b)] for b in range(inner))
            two = sum(h[cells ^ (1 << a) ^ (1 << b)] for a, b in itertools.combinations(range(inner), 2))
            c1 = one + outer * h
            c2 = two + outer * one + math.comb(outer, 2) * h
            self.estimate.append(np.stack([h, h + c1, h + c1 + c2]).astype(np.float32))
            self.probes.append([1, 1 + len(part), 1 + len(part) + math.comb(len(part), 2)])

    def keys(self, fps: np.ndarray) -> list[np.ndarray]:
        return [gather_bits(fps, part) for part in self.partitions]

    def thresholds(self, keys: list[np.ndarray]) -> np.ndarray:
        """Per fingerprint and partition the threshold -1, 0, 1 or 2 of the
        cheapest split (dynamic program over the partitions)."""
        units, n = self.max_bits + 1, len(keys[0])
        best = np.full((units + 1, n), np.inf)
        best[0] = 0
        chosen = []
        for i, key in enumerate(keys):
            cell = (key & _U((1 << _HIST) - 1)).astype(np.int64)
            cost = [np.zeros(n)] + [self.estimate[i][t][cell] + 4.0 * self.probes[i][t] for t in range(3)]
            nxt = np.full_like(best, np.inf)
            pick = np.zeros((units + 1, n), dtype=np.int8)
            for total in range(units + 1):
                for take in range(min(total, 3) + 1):
                    value = best[total - take] + cost[take]
                    better = value < nxt[total]
                    nxt[total][better] = value[better]
                    pick[total][better] = take
            best = nxt
            chosen.append(pick)
        out = np.empty((len(keys), n), dtype=np.int8)
        left = np.full(n, units)
        at = np.arange(n)
        for i in range(len(keys) - 1, -1, -1):
            take = chosen[i][left, at]
            out[i] = take - 1
            left = left - take
        return out

    def rows(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, fingerprint, role) rows; role 0: only found, 1: finds and is
        found, 2: only finds."""
        keys = self.keys(fps)
        limits = self.thresholds(keys)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (key, part) in enumerate(zip(keys, self.partitions)):
            limit = limits[i]
            out.append(self._keyed(i, key, fps, (limit >= 0).astype(np.int8)))
            for t in (1, 2):
                who = np.flatnonzero(limit >= t)
                for flips in itertools.combinations(range(len(part)), t) if len(who) else ():
                    flip = _U(sum(1 << b for b in flips))
                    out.append(self._keyed(i, key[who] ^ flip, fps[who], np.full(len(who), 2, np.int8)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _keyed(self, i: int, key: np.ndarray, fps: np.ndarray, role: np.ndarray):
        """Rows of partition i; keys of hot cells take a block of the other
        bits with them, once for each block."""
        base = mix(key + _U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        hot = self.estimate[i][0][(key & _U((1 << _HIST) - 1)).astype(np.int64)] > HOT_KEY
        if not hot.any():
            return base, fps, role
        rest = [b for p, part in enumerate(self.partitions) if p != i for b in part]
        blocks = self.max_bits + 1
        k, f, r = [base[~hot]], [fps[~hot]], [role[~hot]]
        for j in range(blocks):
            block = gather_bits(fps[hot], rest[j::blocks])
            k.append(mix(base[hot] ^ mix(block + _U((j + 1) << 56))))
            f.append(fps[hot])
            r.append(role[hot])
        return np.concatenate(k), np.concatenate(f), np.concatenate(r)


# ---- verification ---------------------------------------------------------

def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def near_pairs(keys: np.ndarray, fps: np.ndarray, role: np.ndarray, max_bits: int,
               block: int = HOT_KEY) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints under one key within max_bits, as a spanning
    forest of links."""
    order = np.lexsort((fps, keys))
    keys, fps, role = keys[order], fps[order], role[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    a_out, b_out = [], []
    big = np.flatnonzero(size > block)
    alive = np.ones(len(keys), dtype=bool)
    for g in big:
        part = slice(first[g], first[g] + size[g])
        alive[part] = False
        a, b = _refine(np.unique(fps[part]), max_bits, block)
        a_out.append(a)
        b_out.append(b)
    left = np.flatnonzero(alive)               # rows whose partner ``step`` places on may share their key
    step = 1
    while len(left):
        left = left[left + step < len(keys)]
        left = left[keys[left] == keys[left + step]]
        a, b = fps[left], fps[left + step]
        ra, rb = role[left], role[left + step]
        # one of the two must search (1, 2), the other be searchable (0, 1)
        asked = ((ra > 0) & (rb < 2)) | ((rb > 0) & (ra < 2))
        near = asked & (a != b) & (distance(a, b) <= max_bits)
        a_out.append(a[near])
        b_out.append(b[near])
        step += 1
    if not a_out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(a_out), np.concatenate(b_out))


def _refine(fps: np.ndarray, max_bits: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among many distinct fingerprints: the bits in which they differ
    are split into max_bits + 1 blocks, one of which must agree."""
    vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if vary >> b & 1]
    if len(bits) <= max_bits:                  # any two are near
        return fps[1:], np.full(len(fps) - 1, fps[0])
    a_out, b_out = [], []
    for j in range(max_bits + 1):
        a, b = near_pairs(gather_bits(fps, bits[j::max_bits + 1]), fps, np.ones(len(fps), np.int8), max_bits, block)
        a_out.append(a)
        b_out.append(b)
    return forest(np.concatenate(a_out), np.concatenate(b_out))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(k)
    return a[keep], b[keep]


# ---- the operator ---------------------------------------------------------

def partition_count(distinct: int) -> int:
    """Fewer, wider partitions for more fingerprints: keys of 16, 21 or 32
    bits keep the candidates a fingerprint meets about constant."""
    return 4 if distinct <= 1 << 26 else 3 if distinct <= 1 << 34 else 2


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (column fp, each
    once) that connect whatever lies within ``max_bits`` bits."""
    spark = distinct.sparkSession
    rows = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64)
    partitions = bit_partitions(sample.view(np.uint64), partition_count(rows))
    histogram = _histogram(distinct, partitions)
    plan = spark.sparkContext.broadcast(Allocation(partitions, histogram, max_bits))
    tasks = max(1, math.ceil(rows * (len(partitions) + 2) / KEYS_PER_TASK))

    def emit(batch: pa.RecordBatch) -> dict:
        fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        key, fp, role = plan.value.rows(fps)
        return {"task": pa.array((key % _U(tasks)).astype(np.int32)), "key": pa.array(key.view(np.int64)),
                "fp": pa.array(fp.view(np.int64)), "role": pa.array(role)}

    def verify(table: pa.Table) -> pa.Table:
        as_u64 = lambda c: table.column(c).to_numpy().view(np.uint64)
        a, b = near_pairs(as_u64("key"), as_u64("fp"), table.column("role").to_numpy(), max_bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    keyed = map_batches(distinct.select("fp"), emit, "task int, key long, fp long, role byte")
    return keyed.groupBy("task").applyInArrow(verify, "a long, b long")


def _histogram(distinct: DataFrame, partitions: list[list[int]]) -> np.ndarray:
    """Distinct fingerprints by partition and its first 16 bits."""

    def count(batches):
        total = np.zeros((len(partitions), 1 << _HIST), dtype=np.int64)
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for i, part in enumerate(partitions):
                total[i] += np.bincount(gather_bits(fps, part[:_HIST]).astype(np.int64), minlength=1 << _HIST)
        i, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"part": pa.array(i.astype(np.int32)), "cell": pa.array(cell.astype(np.int32)),
                                          "n": pa.array(total[i, cell])})

    cells = (distinct.select("fp").mapInArrow(count, "part int, cell int, n long")
             .groupBy("part", "cell").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros((len(partitions), 1 << _HIST))
    out[cells["part"].to_numpy(dtype=np.int64), cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy()
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id, kept, text_hash, copies per document.

    * Texts without words (null, empty, white space) have fingerprint zero
      and are linked like any other; fewer words than a shingle: the whole
      sequence is the one shingle.
    * component_id: the smallest doc_id reachable over links of at most
      max_bits bits (null only if every id reachable is null).
    * kept: the row of the component with the smallest doc_id (null ids
      first); rows that repeat doc_id and text are one document, with their
      number in ``copies``.
    * An empty table gives an empty result.
    """
    rows = docs.count()
    prints = materialise(fingerprints(docs, shingle).repartition(files_of(rows)), "simhash-prints")
    distinct = materialise(sized(prints.select("fp").distinct(), rows), "simhash-distinct")
    links = near_links(distinct, max_bits)
    found = materialise(components(links, "simhash-links"), "simhash-components")
    ids = prints.groupBy("doc_id", "fp", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"),
                                     F.min(F.struct("doc_id", "text_hash")).alias("first"))
    least = least.join(found, least["fp"] == found["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    least = materialise(sized(least.select("fp", "component", "least", "first"), rows), "simhash-least")
    group = least.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    member = least.select("fp", "component").join(group, "component").select("fp", "component_id", "first")
    out = sized(ids.join(member, "fp"), rows)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                      kept.alias("kept"), "text_hash", "copies")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` (all columns) of which one a component stays."""
    decided = near_duplicates(docs, shingle, max_bits).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_sha"), F.col("copies").alias("_copies"))
    return keep_rows(docs, decided, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
