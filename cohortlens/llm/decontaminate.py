"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton.  Words
of training documents stream through it; at every word the automaton knows
the longest piece of any item that ends there.  A word is hit when it lies
in an occurrence of a window: ``window`` consecutive words of an item, or a
whole item that has fewer.

Streaming every word through Python would be slow, so a task first finds,
with numpy, where windows can start (fingerprints of k consecutive words
looked up in a bitmap of the items' window fingerprints) and streams only
those stretches; the automaton compares the words themselves, so a
fingerprint clash costs time, never a wrong hit.

Tasks build the automata, each of at most about ``block_words`` words, and
write them to the shared folder; a longer item goes in overlapping pieces.
One automaton at a time is broadcast.  Where there is one, documents are
answered in one pass; where there are more, each pass writes the hit spans of
the texts that have any, and the spans are joined back, so memory follows
``block_words`` and not the benchmark.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import free_name, let_go, map_batches, materialise, texts_of
from .wordarrays import ALNUM_WORDS, Words, lower_ascii, run_hash, utf8

WINDOW = 10
BLOCK_WORDS = 200_000
_BITS, _SPARSE = 22, 128  # a bitmap has 2 ** _BITS bits and _SPARSE for each of its windows, at least
_WORD_BYTES = 6          # of a word and the space after it, to guess the number of blocks


def item_words(text: str | None) -> list[bytes]:
    w = Words([lower_ascii(utf8(text))], ALNUM_WORDS)
    return [w.word(i) for i in range(len(w))]


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    ``next``: transitions by word code; ``link``: suffix links; ``length``:
    longest string of the state.  ``items_at`` holds, per state, the items
    that contain its strings; ``whole_at`` the short items that are a suffix
    of them, with their lengths.
    """

    def __init__(self, items: dict[int, list[list[bytes]]], window: int):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set] = defaultdict(set)
        self.short: dict[int, list[tuple[int, set]]] = {}
        lengths = defaultdict(set)
        short_items = defaultdict(set)
        for item, sequences in items.items():
            for words in sequences:
                if not words:
                    continue
                codes = [self.code.setdefault(w, len(self.code)) for w in words]
                last = 0
                for c in codes:
                    last = self._extend(last, c)
                    owners[last].add(item)
                k = min(window, len(codes))
                lengths[k].update(tuple(codes[i:i + k]) for i in range(len(codes) - k + 1))
                if k < window:
                    short_items[tuple(codes)].add(item)
        # items of a state: those of its own ends and of all states below it in the link tree
        self.items_at: list[frozenset] = [frozenset()] * len(self.next)
        gathered: list[set] = [owners.get(s, set()) for s in range(len(self.next))]
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[s] >= window and self.length[self.link[s]] < window:
                self.items_at[s] = frozenset(gathered[s])
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                gathered[self.link[s]] = gathered[self.link[s]] | gathered[s]
        # state of the window-long suffix of a state's strings
        self.window_state = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            up = self.link[s]
            self.window_state[s] = s if self.length[up] < window <= self.length[s] else self.window_state[up]
        whole: dict[int, list[tuple[int, frozenset]]] = defaultdict(list)
        for codes, owning in short_items.items():
            s = 0
            for c in codes:
                s = self.next[s][c]
            whole[s].append((len(codes), frozenset(owning)))
        self.whole_at: list[list[tuple[int, frozenset]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.whole_at[s] = whole.get(s, []) + self.whole_at[self.link[s]]
        # fingerprints of the windows, by window length, as bitmaps
        by_code = sorted(self.code, key=self.code.get)
        prints = Words(by_code, ALNUM_WORDS).fingerprints() if by_code else np.empty(0, np.uint64)
        self.bitmaps: dict[int, np.ndarray] = {}
        for k, windows in sorted(lengths.items()):
            table = np.zeros(1 << max(_BITS, (_SPARSE * len(windows) - 1).bit_length()), dtype=bool)
            flat = prints[np.array(list(windows), dtype=np.int64).reshape(-1)]
            table[run_hash(flat, k)[::k] & np.uint64(len(table) - 1)] = True
            self.bitmaps[k] = np.packbits(table)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:               # the string is already there (an earlier item)
            q = self.next[last][c]
            if self.length[last] + 1 == self.length[q]:
                return q
            return self._split(last, q, c)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._split(p, q, c)
        return new

    def _state(self, nxt: dict[int, int], length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """((start, length) of the longest window ending at each word where
        one ends, items that have an occurring window)."""
        found, items = [], set()
        state = matched = 0
        for at, w in enumerate(words):
            c = self.code.get(w)
            if c is None:
                state = matched = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            nxt = self.next[state].get(c)
            if nxt is None:
                state = matched = 0
                continue
            state, matched = nxt, matched + 1
            span = 0
            if matched >= self.window:
                span = self.window
                items |= self.items_at[self.window_state[state]]
            for k, owning in self.whole_at[state]:
                if k <= matched:
                    span = max(span, k)
                    items |= owning
            if span:
                found.append((at - span + 1, span))
        return found, items

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set]]:
        """Hit flag of every word of a batch, and the items by document."""
        hit = np.zeros(len(words), dtype=bool)
        items: dict[int, set] = {}
        if not len(words) or not self.bitmaps:
            return hit, items
        prints = words.fingerprints()
        maybe = np.zeros(len(words) + 1, dtype=np.int32)
        doc_end = np.repeat(words.doc_first[1:], np.diff(words.doc_first))
        for k, packed in self.bitmaps.items():
            bit = run_hash(prints, k) & np.uint64(8 * len(packed) - 1)
            at = np.flatnonzero(packed[bit >> np.uint64(3)] & (np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8)))
            at = at[at + k <= doc_end[at]]
            np.add.at(maybe, at, 1)
            np.add.at(maybe, at + k, -1)
        for lo, hi in zip(*_runs(np.cumsum(maybe[:-1]) > 0)):
            # a stretch may run over the end of a document: cut it there
            doc = int(np.searchsorted(words.doc_first, lo, side="right")) - 1
            while lo < hi:
                stop = min(hi, int(words.doc_first[doc + 1]))
                found, owning = self.stream([words.word(i) for i in range(lo, stop)])
                for start, length in found:
                    hit[lo + start:lo + start + length] = True
                if owning:
                    items.setdefault(doc, set()).update(owning)
                lo, doc = stop, doc + 1
        return hit, items


def _pieces(words: list[bytes], window: int, block_words: int) -> Iterator[list[bytes]]:
    """Runs of a long item that overlap by window - 1 words, so every window lies in one."""
    for lo in range(0, max(1, len(words) - window + 1), block_words):
        yield words[lo:lo + block_words + window - 1]


def build_automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Automata of all items, each of at most about block_words words, written
    to the shared folder: columns block, shortest (window length), automaton.

    Rows without text are left out and repeated rows go once.  Items are dealt
    by hash into as many groups as their bytes ask for, so the number of
    automata follows the benchmark and not the partitions of its shuffle."""
    rows = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct())
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = 1 + total // (_WORD_BYTES * block_words)

    def build(table: pa.Table) -> pa.Table:
        blocks, block, size = [], defaultdict(list), 0
        for item, text in zip(table["item_id"].to_pylist(), table["text"].to_pylist()):
            for words in _pieces(item_words(text), window, block_words):
                if size and size + len(words) > block_words:
                    blocks.append(SuffixAutomaton(block, window))
                    block, size = defaultdict(list), 0
                if words:
                    block[item].append(words)
                    size += len(words)
        if size:
            blocks.append(SuffixAutomaton(block, window))
        packed = [pickle.dumps(a, protocol=pickle.HIGHEST_PROTOCOL) for a in blocks]
        return pa.table({"block": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                         "shortest": pa.array([min(a.bitmaps) for a in blocks], pa.int32()),
                         "automaton": pa.array(packed, pa.binary())})

    built = (rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))).groupBy("part")
             .applyInArrow(build, "block string, shortest int, automaton binary"))
    return materialise(built, "automata")


def scan_texts(texts: list[str | None], automaton: SuffixAutomaton | None) -> tuple[Words, np.ndarray, dict[int, set]]:
    """Words, hit flags and items by document of a batch of texts."""
    words = Words([lower_ascii(utf8(t)) for t in texts], ALNUM_WORDS)
    if automaton is None:
        return words, np.zeros(len(words), dtype=bool), {}
    return words, *automaton.scan(words)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of every run of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hits(keyed: DataFrame, automaton) -> DataFrame:
    """key, spans (first and end of every hit run, int32 pairs) and items of
    the texts that one broadcast automaton hits."""

    def find(batch: pa.RecordBatch) -> dict | None:
        words, hit, items = scan_texts(texts_of(batch), automaton.value)
        n_hit = _per_document(words, hit)[1]
        docs = np.flatnonzero(n_hit)
        spans = [np.stack(_runs(hit[words.doc_first[d]:words.doc_first[d + 1]]), axis=1).astype("<i4").tobytes() for d in docs]
        return {"key": batch.column(0).take(pa.array(docs)), "spans": pa.array(spans, pa.binary()),
                "items": pa.array([sorted(i for i in items.get(d, ()) if i is not None) for d in docs.tolist()],
                                  pa.list_(pa.string()))} if len(docs) else None

    return map_batches(keyed, find, "key string, spans binary, items array<string>").dropDuplicates(["key"])


def _judge(docs: DataFrame, blocks: DataFrame, answer: Callable, schema: str | StructType) -> DataFrame:
    """``answer(batch, words, hit, items)`` over the batches of ``docs``
    (which has the column text), with the hits of all automata."""
    spark = docs.sparkSession
    names = [r["block"] for r in blocks.select("block").collect()]

    def block(name: str):
        return spark.sparkContext.broadcast(pickle.loads(blocks.filter(F.col("block") == name).first()["automaton"]))

    if len(names) < 2:
        one = block(names[0]) if names else None

        def direct(batch: pa.RecordBatch) -> dict:
            return answer(batch, *scan_texts(texts_of(batch), one.value if one else None))

        return map_batches(docs, direct, schema)
    key, spans, owners = (free_name(docs, n) for n in ("text_key", "hit_spans", "hit_items"))
    text_key = F.sha2(F.col("text"), 256)
    passes = []
    for name in names:
        automaton = block(name)
        passes.append(materialise(_hits(docs.select(text_key.alias("key"), "text").filter("text is not null"), automaton), "hits"))
        automaton.destroy()
    found = (reduce(DataFrame.unionAll, passes).groupBy(F.col("key").alias(key))
             .agg(F.collect_list("spans").alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(owners)))
    found = materialise(found, "hits")
    let_go(spark, *passes)
    own = docs.columns

    def joined(batch: pa.RecordBatch) -> dict:
        words = Words([lower_ascii(utf8(t)) for t in texts_of(batch)], ALNUM_WORDS)
        hit, items = np.zeros(len(words), dtype=bool), {}
        cols = dict(zip(batch.schema.names, batch.columns))
        for d, (parts, owning) in enumerate(zip(cols[spans].to_pylist(), cols[owners].to_pylist())):
            for lo, hi in (pair for part in parts or () for pair in np.frombuffer(part, "<i4").reshape(-1, 2)):
                hit[words.doc_first[d] + lo:words.doc_first[d] + hi] = True
            if owning:
                items[d] = set(owning)
        return answer(batch.select(own), words, hit, items)

    return map_batches(docs.withColumn(key, text_key).join(found, key, "left").drop(key), joined, schema)


def _per_document(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(words.doc_first)
    sums = np.concatenate(([0], np.cumsum(hit)))
    return n, sums[words.doc_first[1:]] - sums[words.doc_first[:-1]]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``.

    Null texts have no words.  Rows that repeat a doc_id give a row each.
    Items with null text or no words match nothing; items whose id is null
    hit words but are not listed among the items.  Empty documents: an empty
    result; an empty benchmark: nothing is hit.
    """
    def score(batch: pa.RecordBatch, words: Words, hit: np.ndarray, items: dict[int, set]) -> dict:
        n, n_hit = _per_document(words, hit)
        owning = [sorted(i for i in items.get(d, ()) if i is not None) for d in range(len(n))]
        return {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(o) for o in owning], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(o).encode()).hexdigest() for o in owning]),
                "contaminated": pa.array(n_hit > 0)}

    return _judge(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")),
                  build_automata(benchmark, window, block_words), score,
                  "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = WINDOW - 1,
                         max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    Spans of hit words longer than ``max_span`` words are cut out of the
    text together with what stands between their words (short items, whose
    windows are shorter, are cut too when they are all of the span); a
    document of whose words more than ``max_coverage`` are hit goes as a
    whole.  ``n_chars``, where it exists, follows the new text.  Documents
    without hits come back unchanged, null and empty texts as well.
    """
    blocks = build_automata(benchmark, window, block_words)
    text_out, keep_out = free_name(docs, "clean_text"), free_name(docs, "stays")
    shortest = blocks.agg(F.least(F.lit(max_span + 1), F.min("shortest"))).first()[0]

    def cut(batch: pa.RecordBatch, words: Words, hit: np.ndarray, _items: dict[int, set]) -> dict:
        texts = texts_of(batch)
        n, n_hit = _per_document(words, hit)
        stays = n_hit <= max_coverage * np.maximum(n, 1)
        out = list(texts)
        sizes = np.array([len(utf8(t)) for t in texts])
        base = np.concatenate(([0], np.cumsum(sizes + 1)))
        for d in np.flatnonzero((n_hit > 0) & stays):
            raw, kept, at = utf8(texts[d]), [], 0
            for lo, hi in zip(*_runs(hit[words.doc_first[d]:words.doc_first[d + 1]])):
                if hi - lo < shortest:
                    continue
                first = int(words.starts[words.doc_first[d] + lo] - base[d])
                last = int(words.ends[words.doc_first[d] + hi - 1] - base[d])
                kept.append(raw[at:first])
                at = last
            out[d] = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
        cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        return cols | {text_out: pa.array(out, pa.string()), keep_out: pa.array(stays)}

    schema = StructType([*docs.schema.fields, StructField(text_out, StringType()), StructField(keep_out, BooleanType())])
    done = _judge(docs, blocks, cut, schema).filter(F.col(keep_out))
    new_text = F.col(text_out)
    changed = ~new_text.eqNullSafe(F.col("text"))
    out = {"text": new_text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(changed, F.length(new_text)).otherwise(F.col("n_chars")).cast(kind)
    return done.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
