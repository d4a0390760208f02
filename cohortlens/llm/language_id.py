"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter's maximum over the window (max pooling) feeds a softmax over the
languages.  The network is trained in numpy (Adam) on a bounded sample of
labelled texts; every byte of a text lies in some window, and a text's
answer comes from the mean log-probability of its windows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .wordarrays import utf8

WIDTHS = (2, 3, 4)
FILTERS = 16              # of each width
EMBED = 8
WINDOW = 256              # bytes
PER_LANGUAGE = 400        # labelled texts of each language the network is fitted on
TRAIN_CHARS = 20_000      # longest text that is taken for fitting
WINDOWS_PER_TEXT = 4      # for fitting
EPOCHS, BATCH, RATE = 8, 64, 0.01
FOLDS, TEST_FOLD = 4, 2
CHUNK = 16                # windows computed at once; their responses stay in a core's cache
NONE = "und"
_WIDE = max(WIDTHS)


def has_letter(text: str) -> bool:
    """Does the text hold a character of Unicode's letter classes (as ``\\p{L}`` does in training)?"""
    return any(c.isalpha() for c in text)


def windows_of(data: bytes) -> np.ndarray:
    """All fixed-length windows of a text (rows), zero padded; neighbours
    share the bytes that the widest filter needs."""
    step = WINDOW - _WIDE + 1
    n = max(1, -(-(len(data) - _WIDE + 1) // step))
    buf = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    buf[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[::step]


class ByteNetwork:
    """Embedding, filters (width, embedding -> filter; narrow filters are zero
    at their last places), output layer; ``languages`` in sorted order."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((_WIDE, EMBED, n), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS:(i + 1) * FILTERS] = 1
        self.weights = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "shift": np.zeros(n, dtype=np.float32),
            "out": rng.normal(0, 0.1, (n, len(languages))).astype(np.float32),
            "bias": np.zeros(len(languages), dtype=np.float32),
        }

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """(filters, windows, places) before pooling: places lie next to each
        other, so the product and the maximum run over contiguous memory."""
        places = windows.shape[1] - _WIDE + 1
        x = np.ascontiguousarray(self.weights["embed"].T)[:, windows]                 # embed, n, bytes
        patches = np.empty((_WIDE, EMBED, len(windows), places), dtype=np.float32)
        for k in range(_WIDE):
            patches[k] = x[:, :, k:k + places]
        filters = self.weights["filter"].reshape(_WIDE * EMBED, -1).T
        return (filters @ patches.reshape(_WIDE * EMBED, -1)).reshape(-1, len(windows), places)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), dtype=np.float64)
        for lo in range(0, len(windows), CHUNK):
            pooled = np.maximum(self.responses(windows[lo:lo + CHUNK]).max(axis=2).T + self.weights["shift"], 0)
            out[lo:lo + CHUNK] = pooled @ self.weights["out"] + self.weights["bias"]
        return out - np.logaddexp.reduce(out, axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        resp = self.responses(windows)
        at = resp.argmax(axis=2)
        top = np.take_along_axis(resp, at[:, :, None], axis=2)[:, :, 0].T + p["shift"]
        at = at.T
        pooled = np.maximum(top, 0)
        logits = pooled @ p["out"] + p["bias"]
        prob = np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True))
        prob[np.arange(len(target)), target] -= 1
        prob /= len(target)
        back = (prob @ p["out"].T) * (top > 0)
        seen = windows[np.arange(len(windows))[:, None, None], at[:, :, None] + np.arange(_WIDE)]   # n, filters, wide
        patch = p["embed"][seen]
        moved = (back[:, :, None, None] * p["filter"].transpose(2, 0, 1)[None]).reshape(-1, EMBED)
        embed = np.stack([np.bincount(seen.ravel(), moved[:, e], 256) for e in range(EMBED)], axis=1)
        return {"embed": embed, "filter": np.einsum("nf,nfwe->wef", back, patch) * self.mask, "shift": back.sum(axis=0),
                "out": pooled.T @ prob, "bias": prob.sum(axis=0)}

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                pick = order[lo:lo + BATCH]
                step += 1
                for k, g in self.gradients(windows[pick], target[pick]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - RATE / (1 + epoch) * move).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability by the windows' mean log-probability;
        NONE and 0 for null, for texts without a letter, or without languages."""
        told, score = [NONE] * len(texts), np.zeros(len(texts))
        who = [i for i, t in enumerate(texts) if self.languages and t is not None and has_letter(t)]
        if who:
            cut = [windows_of(utf8(texts[i])) for i in who]
            first = np.cumsum([0, *map(len, cut)])
            logp = self.log_probabilities(np.concatenate(cut))
            mean = np.add.reduceat(logp, first[:-1], axis=0) / np.diff(first)[:, None]
            mean -= np.logaddexp.reduce(mean, axis=1, keepdims=True)
            for i, m in zip(who, mean):
                told[i], score[i] = self.languages[int(m.argmax())], min(1.0, float(np.exp(m.max())))
        return told, score


def train(rows: list[tuple[str, str]], seed: int = 7) -> ByteNetwork:
    """Network fitted on (lang, text) rows, in any order."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    net = ByteNetwork(sorted({lang for lang, _ in rows}), seed)
    windows, target = [], []
    for lang, text in rows:
        cut = windows_of(utf8(text))
        cut = cut[rng.permutation(len(cut))[:WINDOWS_PER_TEXT]]
        windows.append(cut)
        target += [net.languages.index(lang)] * len(cut)
    if len(net.languages) > 1:
        net.fit(np.concatenate(windows), np.array(target), seed=seed)
    return net


def fold(docs: DataFrame):
    """crc32 of the id as text modulo FOLDS; null ids count as held out."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % FOLDS, F.lit(TEST_FOLD))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """Bounded sample: of each language the ``per_language`` texts outside the
    held-out fold, up to TRAIN_CHARS long and with a letter, with the smallest
    seeded hash of their text; equal texts count once.

    The number of different texts of each language (hashes alone are shuffled, a
    number a language comes to the driver) gives a hash bound that about twice
    ``per_language`` of them meet; only those few are gathered and ranked."""
    usable = (docs.filter(fold(docs) != TEST_FOLD).filter("lang is not null").filter(F.length("text").between(1, TRAIN_CHARS))
              .filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(5), "text").alias("at")))
    counts = usable.select("lang", "at").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return []
    bounds = [x for r in counts for x in (F.lit(r["lang"]), F.lit(-(1 << 63) + min((1 << 64) - 1, (1 << 65) * per_language // r["n"])))]
    few = usable.filter(F.col("at") <= F.create_map(*bounds)[F.col("lang")]).dropDuplicates(["lang", "at"])
    first = Window.partitionBy("lang").orderBy("at", "text")
    picked = few.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    return [(r["lang"], r["text"]) for r in picked.select("lang", "text").collect()]


def identify(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0.  Rows
    that repeat a doc_id are judged each; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def judge(batch: pa.RecordBatch) -> dict:
        told, score = held.value.predict(texts_of(batch))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(told, pa.string()),
                "score": pa.array(score)}

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs) == TEST_FOLD).alias("held_out"),
                         docs["text"].alias("text"))
    return map_batches(source, judge, "doc_id long, held_out boolean, lang_pred string, score double")
