"""Packing token sequences by minimum bin slack.

Documents are tokenized, closed with an end id and cut into full windows
and one remainder.  The plan works on the histogram of piece lengths, which
has at most ``capacity`` entries at any corpus size: for every window a
bitset subset-sum over the remaining lengths finds the multiset, holding the
longest remaining piece, that fills the window best; backtracking gives its
counts, and the pattern is used as often as the remaining counts allow.
Spark numbers the pieces of each length (hot lengths are salted), and a
piece's number says which window of which pattern it goes to.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, texts_of
from .wordarrays import SPACE_WORDS, Words, utf8

CAPACITY = 2048
END_ID = 1
CACHE_WORDS = 3_000_000      # words a task keeps encoded; full: it starts anew
ROWS_PER_SALT = 200_000


# ---- tokens ---------------------------------------------------------------

class WordEncoder:
    """Token ids of texts by a tokenizer whose tokens never span white space.

    Each white-space-delimited word is encoded once and kept under its 64-bit
    fingerprint; a text's ids are gathered from its words' ids.  Entry 0
    stands for the end id."""

    def __init__(self, tokenizer_json: str, end_id: int):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.end_id = end_id
        size = self.tok.get_vocab_size()
        self.closes = np.zeros(size, dtype=bool)   # tokens that end a word
        for token, i in self.tok.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.tails = {t: self.tok.encode(t, add_special_tokens=False).ids for t in ".,"}
        self._reset()

    def _reset(self) -> None:
        """Entries: first and count cut an entry's ids out of ``flat``;
        ``prints`` are the known words' fingerprints, sorted, ``entry`` the
        entry of each."""
        self.first = np.zeros(1, dtype=np.int64)
        self.count = np.ones(1, dtype=np.int64)
        self.flat = np.array([self.end_id], dtype=np.uint32)
        self.prints = np.empty(0, dtype=np.uint64)
        self.entry = np.empty(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each closed by the end id; ids a text)."""
        if len(self.prints) > CACHE_WORDS:
            self._reset()
        # ASCII white space separates; other white space stays inside a word, where the tokenizer drops it
        words = Words([utf8(t) for t in texts], SPACE_WORDS)
        at = np.insert(self._entries(words), words.doc_first[1:], 0)
        per_text = np.diff(words.doc_first) + 1
        count = self.count[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        pos = np.arange(total, dtype=np.int64) + np.repeat(self.first[at] - (ends - count), count)
        sizes = np.add.reduceat(count, np.cumsum(per_text) - per_text) if len(per_text) else count
        return self.flat[pos], sizes

    def _entries(self, words: Words) -> np.ndarray:
        """The entry of every word; unknown words are encoded first."""
        prints, example, inverse = np.unique(words.fingerprints(), return_index=True, return_inverse=True)
        if not len(prints):
            return np.empty(0, dtype=np.int64)
        at = np.searchsorted(self.prints, prints)
        known = np.zeros(len(prints), dtype=bool)
        inside = at < len(self.prints)
        known[inside] = self.prints[at[inside]] == prints[inside]
        new = ~known
        if new.any():
            base = len(self.count)
            self._learn([words.word(i).decode("utf-8", "replace") for i in example[new].tolist()])
            self.prints = np.insert(self.prints, at[new], prints[new])
            self.entry = np.insert(self.entry, at[new], np.arange(base, len(self.count)))
            at = at + (np.cumsum(new) - new)      # places moved by the insertions before them
        return self.entry[at][inverse]

    def _learn(self, words: list[str]) -> None:
        """Encode new words; entries are appended in their order."""
        cores = [_core(w) for w in words]
        new = list(dict.fromkeys(core for core, _tail in cores))
        coded = self._letters([c for c in new if c.isalpha()])
        other = [c for c in new if not c.isalpha()]
        coded.update(zip(other, (e.ids for e in self.tok.encode_batch_fast(other, add_special_tokens=False))))
        flat: list[int] = []
        count = np.empty(len(words), dtype=np.int64)
        for i, (core, tail) in enumerate(cores):
            ids = coded[core]
            flat += ids
            count[i] = len(ids)
            if tail:
                flat += self.tails[tail]
                count[i] += len(self.tails[tail])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.uint32)])

    def _letters(self, words: list[str]) -> dict[str, list[int]]:
        """Words of letters only are one token run each, so many are encoded
        as one text and cut after the tokens that end a word."""
        out: dict[str, list[int]] = {}
        for k in range(0, len(words), 20_000):
            part = words[k:k + 20_000]
            ids = self.tok.encode(" ".join(part), add_special_tokens=False).ids
            cut = (np.flatnonzero(self.closes[ids]) + 1).tolist() if ids else []
            if len(cut) == len(part) and cut and cut[-1] == len(ids):
                out.update((w, ids[lo:hi]) for w, lo, hi in zip(part, [0, *cut], cut))
            else:
                out.update(zip(part, (e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False))))
        return out


def _core(word: str) -> tuple[str, str]:
    """(what decides the ids, closing mark): a word of Latin letters is lower-
    cased as the tokenizer does, and a comma or full stop after it is a token
    run of its own; any other word stays whole."""
    tail = word[-1] if word[-1] in ".," else ""
    core = word[:-1] if tail else word
    return (core.lower(), tail) if core.isalpha() and max(core) < "\u0100" else (word, "")


_ENCODERS: dict[tuple[int, int], WordEncoder] = {}


def _encoder(tokenizer_json: str, end_id: int) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    key = (hash(tokenizer_json), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json, end_id)
    return _ENCODERS[key]


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece.

    A document (null text: empty) is its ids and the end id; it is cut after
    every ``capacity`` ids.  The tokenizer file is read on the driver and
    sent to the tasks (its size does not depend on the data)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batch: pa.RecordBatch) -> dict:
        enc = _encoder(tokenizer.value, end_id)
        texts, ids_of = texts_of(batch), batch.column(0).to_pylist()
        cols: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
        if with_ids:
            cols["ids"] = []
        ids, sizes = enc.encode(texts)
        at = 0
        for d, n in zip(ids_of, sizes.tolist()):
            for start in range(0, n, capacity):
                piece = ids[at + start:at + min(n, start + capacity)]
                cols["doc_id"].append(d)
                cols["start"].append(start)
                cols["length"].append(len(piece))
                cols["ids_crc32"].append(zlib.crc32(piece.astype("<u4", copy=False).data))
                cols["doc_tokens"].append(n)
                if with_ids:
                    cols["ids"].append(piece.astype(np.int32))
            at += n
        kinds = {"ids": pa.list_(pa.int32())}
        return {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()}

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), cut, schema)


# ---- plan -----------------------------------------------------------------

def padding(fill: int, capacity: int) -> int:
    """Padding of a window: none when full or at a power of two."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def fill_window(lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset {length: count} with the longest remaining length that
    leaves the least padding.  ``lengths``: remaining lengths, ascending."""
    longest = lengths[-1]
    room = capacity - longest
    reach = 1
    steps: list[tuple[int, int]] = []          # (length, reach before it)
    full = 1 << room
    mask = (full << 1) - 1
    for at in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        if reach & full:
            break
        n = lengths[at]
        copies = min(left[n] - (n == longest), room // n)
        if copies <= 0:
            continue
        steps.append((n, reach))
        # copies 1, 2, 4, ... and the rest make every count from 0 to copies
        block = 1
        while copies > 0:
            take = min(block, copies)
            reach |= (reach << (n * take)) & mask
            copies -= take
            block *= 2
    if reach & full:
        total = room
    else:
        best = reach.bit_length() - 1
        total, least = best, padding(best + longest, capacity)
        power = 1 << (longest - 1).bit_length()
        while power <= capacity:
            if power - longest <= best and reach >> (power - longest) & 1 and least > 0:
                total, least = power - longest, 0
            power *= 2
    counts = {longest: 1}
    for n, before in reversed(steps):
        while not before >> total & 1:         # a copy of n is needed to reach this sum
            total -= n
            counts[n] = counts.get(n, 0) + 1
    return counts


def minimum_slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(multiset of lengths, how many windows use it)] covering all pieces."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    if left.get(capacity):
        plan.append(({capacity: 1}, left.pop(capacity)))
    lengths = sorted(left)
    while lengths:
        counts = fill_window(lengths, left, capacity)
        times = min(left[n] // c for n, c in counts.items())
        plan.append((counts, times))
        for n, c in counts.items():
            left[n] -= c * times
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
    return plan


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """(length, first number, end number, copies, first sequence, offset) of
    each use of a length: pieces of that length numbered from first to end
    go there, ``copies`` to a sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for counts, times in plan:
        offset = 0
        for n in sorted(counts, reverse=True):
            first = used.get(n, 0)
            used[n] = first + counts[n] * times
            rows.append((n, first, used[n], counts[n], sequence, offset))
            offset += n * counts[n]
        sequence += times
    return rows


# ---- placement ------------------------------------------------------------

def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (at least doc_id, start, length) with sequence_id and
    offset.  An empty table stays empty."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(1, math.ceil(sum(counts.values()) / ROWS_PER_SALT))
    order = [c for c in pieces.columns if c != "ids"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    sizes = sizes.select("length", "_salt", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    numbered = (salted.withColumn("_nr", number.cast("long")).join(sizes, ["length", "_salt"])
                .withColumn("_nr", F.col("_nr") + F.col("_before")))
    # at most a few uses for each of ``capacity`` lengths: bounded whatever the corpus size
    uses = spark.createDataFrame(plan_rows(minimum_slack_plan(counts, capacity)),
                                 "_length long, _first long, _end long, _copies long, _sequence long, _offset long")
    here = ((F.col("length") == F.col("_length")) & (F.col("_nr") >= F.col("_first")) & (F.col("_nr") < F.col("_end")))
    placed = numbered.join(F.broadcast(uses), here)
    nth = F.col("_nr") - F.col("_first")
    return placed.select(*pieces.columns,
                         (F.col("_sequence") + F.floor(nth / F.col("_copies"))).cast("long").alias("sequence_id"),
                         (F.col("_offset") + (nth % F.col("_copies")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    Null texts and empty texts are one piece, the end id alone.  Rows that
    repeat a doc_id are documents of their own.  Empty table: no pieces.
    Null doc_ids stay null."""
    pieces = materialise(tokenized_pieces(docs, tokenizer_file, capacity, end_id, with_ids), "pieces")
    return place_pieces(pieces, capacity)


def packed_sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids of a ``pack(..., with_ids=True)`` result; padded up
    to ``capacity`` unless the sequence is a power of two long."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    ids = F.flatten(F.transform("_p", lambda x: x["ids"]))
    n = F.size(ids)
    power = F.bit_count(n.cast("long")) == 1
    pad = F.when(power, F.lit(0)).otherwise(F.lit(capacity) - n)
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
