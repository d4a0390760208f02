"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two strings counts the subsequences of four letters they
share, each weighted by LAMBDA ** (letters it spans) in both strings, up to
a span of seven: up to three inserted characters or gaps inside four letters
still match.  Landmarks are short pieces of labelled toxic and clean texts;
the Nyström map turns a fragment into its whitened kernel values against
them, and a squared-hinge support vector machine is fitted on the fragments
(a toxic text is toxic by its worst fragment, so each round takes every
text's highest fragment under the last machine).

With the machine fitted, kernel, Nyström map and weights are linear in the
subsequence counts, so they fold into one table over all four-letter
subsequences.  Scoring a text is then a sum of table look-ups at every
position, a sliding sum over a fragment, and the maximum over the text: the
whole text, in numpy, in constant memory per slice.
"""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import free_name, map_batches, texts_of

N = 4                    # letters of a subsequence
MAX_SPAN = 7             # characters it may span
LAMBDA = 0.7
FRAGMENT = 10            # start positions of a fragment
LANDMARKS = 64           # at the start; each round adds a quarter
ROUNDS = 6
RIDGE = 1e-5
TRAIN_PER_CLASS = 1500   # labelled texts of each class the machine is fitted on
TRAIN_CHARS = 20_000     # longest text that is taken for fitting
FOLDS, TEST_FOLD = 5, 0
SLICE = 1_000_000        # characters scored at once
SEPARATOR = 31           # stands for every character that is no letter; 0 pads and never matches
_GAP = FRAGMENT + MAX_SPAN


def _symbol_table() -> np.ndarray:
    """Code points below 0x250 to symbols: a-z (case and accents folded) are
    1..26, other letters 27, everything else the separator."""
    out = np.full(0x250, SEPARATOR, dtype=np.int32)
    for cp in range(0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch.lower())[:1]
        if "a" <= base <= "z":
            out[cp] = ord(base) - 96
        elif ch.isalpha():
            out[cp] = 19 if ch == "ß" else 27
    return out


_TABLE = _symbol_table()
# offsets of the four letters, grouped by span
PATTERNS = [(0, *c, s - 1) for s in range(N, MAX_SPAN + 1) for c in itertools.combinations(range(1, s - 1), N - 2)]


def symbols(text: str) -> np.ndarray:
    """Symbols of a text; letters beyond the table take 28..30 by code point."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _TABLE[np.minimum(cps, 0x24F)]
    far = np.flatnonzero(cps >= 0x250)
    if len(far):
        out[far] = np.fromiter((28 + int(c) % 3 if chr(c).isalpha() else SEPARATOR for c in cps[far]), np.int32, len(far))
    if len(out) > 1:      # a run of separators is one
        out = out[np.concatenate(([True], (out[1:] != SEPARATOR) | (out[:-1] != SEPARATOR)))]
    return out


def _codes(s: np.ndarray, pattern: tuple[int, ...], n: int) -> np.ndarray:
    a, b, c, d = pattern
    return (s[a:a + n] << 15) + (s[b:b + n] << 10) + (s[c:c + n] << 5) + s[d:d + n]


def position_scores(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of all subsequences starting at each position of ``s``, which
    must end in MAX_SPAN separators."""
    n = len(s) - MAX_SPAN
    pairs = [(s[:-g] << 5) + s[g:] for g in range(1, MAX_SPAN - N + 2)]
    high = [p << 10 for p in pairs]
    out = np.zeros(n, dtype=np.float32)
    span = N
    layer = np.zeros(n, dtype=np.float32)
    for p in PATTERNS + [(0, 0, 0, MAX_SPAN)]:
        if p[-1] + 1 != span:
            out += layer * np.float32(LAMBDA ** span)
            layer[:] = 0
            span = p[-1] + 1
        if span > MAX_SPAN:
            break
        layer += weights[high[p[1] - 1][:n] + pairs[p[3] - p[2] - 1][p[2]:p[2] + n]]
    return out


def fragment_scores(scores: np.ndarray) -> np.ndarray:
    """Sum over the FRAGMENT positions from each position on."""
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64), np.zeros(0)))
    end = np.minimum(np.arange(len(scores)) + FRAGMENT, len(scores))
    return total[end] - total[:-1]


def pieces(text: str | None) -> list[str]:
    """A text in pieces of at most SLICE characters that overlap by more than
    a fragment."""
    text = text or ""
    return [text[k:k + SLICE] for k in range(0, max(1, len(text)), SLICE - 2 * _GAP)]


def best_fragments(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Highest fragment score of each text, and the symbols of that fragment."""
    best = np.zeros(len(texts))
    where: list[np.ndarray] = [np.zeros(_GAP, dtype=np.int32)] * len(texts)
    queue = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    lo = 0
    seen = np.zeros(len(texts), dtype=bool)
    while lo < len(queue):
        hi, size, joined, first = lo, 0, [], []
        while hi < len(queue) and (hi == lo or size + len(queue[hi][1]) <= SLICE):
            first.append(sum(map(len, joined[-2:])) + (first[-1] if first else 0))
            joined += [symbols(queue[hi][1]), np.zeros(_GAP, dtype=np.int32)]
            size += len(queue[hi][1])
            hi += 1
        s = np.concatenate([*joined, np.zeros(MAX_SPAN, dtype=np.int32)])
        frag = fragment_scores(position_scores(s, weights))
        starts = np.array(first, dtype=np.int64)
        tops = np.maximum.reduceat(frag, starts)
        for (i, _p), start, stop, top in zip(queue[lo:hi], starts, [*starts[1:], len(frag)], tops):
            if not seen[i] or top > best[i]:
                at = start + int(np.argmax(frag[start:stop]))
                cut = s[at:at + _GAP]
                best[i], where[i], seen[i] = top, np.pad(cut, (0, _GAP - len(cut))), True
        lo = hi
    return best, where


# ---- training -------------------------------------------------------------

class Machine:
    """A fitted machine: subsequence weights, intercept, probability scale."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margin = best_fragments(texts, self.weights)[0] + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


def landmark_strings(toxic: list[np.ndarray], clean: list[np.ndarray], count: int) -> list[tuple[int, ...]]:
    """Landmarks: letter runs of 4 to 7 that mark toxic texts (greedy cover
    of the toxic texts by runs that are rare in clean ones), and as many runs
    spread over the clean texts as places are left."""
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in range(N, 8):
        codes, doc = [], []
        for d, s in enumerate([*toxic, *clean]):
            if len(s) < size:
                continue
            n = len(s) - size + 1
            c, ok = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
            for j in range(size):
                c = (c << 5) | s[j:j + n]
                ok &= s[j:j + n] < SEPARATOR
            c = np.unique(c[ok])
            codes.append(c)
            doc.append(np.full(len(c), d))
        if codes:
            grams[size] = np.concatenate(codes), np.concatenate(doc)
    n_toxic, n_clean = max(1, len(toxic)), max(1, len(clean))
    found: list[tuple[int, int, np.ndarray]] = []      # (size, code, toxic texts)
    for size, (codes, doc) in grams.items():
        order = np.lexsort((doc, codes))
        codes, doc = codes[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else []
        hits = np.add.reduceat((doc < len(toxic)).astype(np.int64), first) if len(first) else np.empty(0)
        total = np.diff(np.append(first, len(codes)))
        rate, other = hits / n_toxic, (total - hits) / n_clean
        for g in np.flatnonzero((hits >= 3) & (rate >= 10 * other)):
            owners = doc[first[g]:first[g] + total[g]]
            found.append((size, int(codes[first[g]]), owners[owners < len(toxic)]))
    covered = np.zeros(len(toxic), dtype=np.int64)
    out: list[tuple[int, ...]] = []
    while found and len(out) < count * 3 // 4:
        gain = [((covered[o] < 2).sum(), size) for size, _c, o in found]
        at = max(range(len(found)), key=lambda i: (gain[i], -found[i][1]))
        if gain[at][0] < 3:
            break
        size, code, owners = found.pop(at)
        out.append(_extended(tuple((code >> 5 * (size - 1 - j)) & 31 for j in range(size)), [toxic[o] for o in owners]))
        covered[owners] += 1
    for d, s in enumerate(clean):
        run = [int(x) for x in s[d % 50:400] if x < SEPARATOR][:6]
        if len(out) >= count:
            break
        if len(run) == 6 and d % max(1, n_clean // count) == 0:
            out.append(tuple(run))
    return list(dict.fromkeys(out)) or [(1, 2, 3, 4)]


def _extended(run: tuple[int, ...], owners: list[np.ndarray]) -> tuple[int, ...]:
    """The run, lengthened while most of its places in the toxic texts go on
    with the same letter."""
    pattern = bytes(run)
    texts = [s.astype(np.uint8).tobytes() for s in owners]
    for side in (1, -1) * 8:
        around: dict[int, int] = {}
        total = 0
        for text in texts:
            at = text.find(pattern)
            while at >= 0:
                edge = at + len(pattern) if side > 0 else at - 1
                if 0 <= edge < len(text):
                    around[text[edge]] = around.get(text[edge], 0) + 1
                total += 1
                at = text.find(pattern, at + 1)
        if around:
            letter = max(around, key=around.get)
            if letter and around[letter] >= 0.6 * total and len(pattern) < 12:
                pattern = pattern + bytes([letter]) if side > 0 else bytes([letter]) + pattern
    return tuple(pattern)


def subsequences(string: tuple[int, ...]) -> dict[int, float]:
    """Subsequence code to weight in one string."""
    s = np.array([*string, *[0] * MAX_SPAN], dtype=np.int32)
    out: dict[int, float] = {}
    for p in PATTERNS:
        for code in _codes(s, p, len(string)).tolist():
            if all(code >> 5 * j & 31 for j in range(N)):
                out[code] = out.get(code, 0.0) + LAMBDA ** (p[-1] + 1)
    return out


class Nystrom:
    """Kernel values against the landmarks, whitened by K_zz ** -1/2."""

    def __init__(self, landmarks: list[tuple[int, ...]]):
        maps = [subsequences(z) for z in landmarks]
        self.codes = np.array(sorted({c for m in maps for c in m}), dtype=np.int64)
        self.phi = np.zeros((len(self.codes), len(maps)))
        for j, m in enumerate(maps):
            self.phi[np.searchsorted(self.codes, list(m)), j] = list(m.values())
        self.phi /= np.sqrt((self.phi ** 2).sum(axis=0))
        values, vectors = np.linalg.eigh(self.phi.T @ self.phi)
        keep = values > 1e-6
        self.whiten = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T

    def features(self, fragments: np.ndarray) -> np.ndarray:
        """(fragments, landmarks) from symbols of shape (fragments, _GAP)."""
        row_of = np.full(1 << 20, -1, dtype=np.int32)
        row_of[self.codes] = np.arange(len(self.codes))
        out = np.zeros((len(fragments), self.phi.shape[1]))
        flat = fragments.astype(np.int32)
        for p in PATTERNS:
            a, b, c, d = (flat[:, k:k + FRAGMENT] for k in p)
            rows = row_of[(a << 15) + (b << 10) + (c << 5) + d]
            who, col = np.nonzero(rows >= 0)
            np.add.at(out, who, LAMBDA ** (p[-1] + 1) * self.phi[rows[who, col]])
        return out @ self.whiten

    def table(self, w: np.ndarray) -> np.ndarray:
        """Subsequence weights of a linear function of the features."""
        out = np.zeros(1 << 20)
        out[self.codes] = self.phi @ (self.whiten @ w)
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Primal Newton steps of a linear machine with squared hinge loss."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    reg = np.full(xb.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(50):
        active = y * (xb @ w) < 1
        a = xb[active] * cost[active, None]
        new = np.linalg.solve(a.T @ xb[active] / len(x) + np.diag(reg), a.T @ y[active] / len(x))
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve on smoothed labels; an example
    counts ``cost`` times."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        off, s = cost * (p - target), cost * p * (1 - p)
        g = np.array([(off * margin).sum(), off.sum()])
        h = np.array([[(s * margin ** 2).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def class_costs(toxic: int, clean: int, counts: tuple[int, int] | None) -> tuple[float, float]:
    """Cost of a toxic and of a clean text when ``toxic`` and ``clean`` texts
    stand for ``counts`` labelled ones: true share over sampled share."""
    true = counts if counts and min(counts) > 0 else (toxic, clean)
    return tuple(n / sum(true) * (toxic + clean) / k for n, k in zip(true, (toxic, clean)))


def fit(toxic: list[str], clean: list[str], rounds: int = ROUNDS, counts: tuple[int, int] | None = None) -> Machine:
    """Machine fitted on labelled texts.  Without toxic or without clean
    texts every score is near the one class seen (0.5 without any).

    ``counts``: how many labelled toxic and clean texts the given ones were
    drawn from (none: they are all).  Hinge and logistic curve weigh the
    classes by them, so the scores keep the true share of toxic texts.

    Every round scores all texts with the last machine, takes each text's
    highest fragment as an example and the highest clean fragments as
    further landmarks, and fits again."""
    if not toxic or not clean:
        sign = (len(toxic) > 0) - (len(clean) > 0)
        return Machine(np.zeros(1 << 20), 0.0, 1.0, 4.0 * sign)
    landmarks = landmark_strings([symbols(t) for t in toxic], [symbols(t) for t in clean], LANDMARKS)
    texts, y = [*toxic, *clean], np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    cost = class_costs(len(toxic), len(clean), counts)
    # first round: the plain kernel to the landmarks
    map_ = Nystrom(landmarks)
    table = np.zeros(1 << 20, dtype=np.float32)
    table[map_.codes] = map_.phi.max(axis=1)
    clean_frags, best = [], None
    for _ in range(rounds):
        score, frags = best_fragments(texts, table)
        frags = np.stack(frags)
        clean_frags.append(frags[y < 0])
        hardest = np.argsort(-score[y < 0], kind="stable")[:200]
        landmarks = list(dict.fromkeys([*landmarks, *_runs(frags[y < 0][hardest])[:LANDMARKS // 4]]))
        map_ = Nystrom(landmarks)
        # toxic texts count with their present fragment, clean ones with all fragments so far
        x = map_.features(np.vstack([frags[y > 0], *clean_frags]))
        t = np.where(np.arange(len(x)) < len(toxic), 1.0, -1.0)
        w, bias = squared_hinge(x, t, np.where(t > 0, *cost))
        table = map_.table(w).astype(np.float32)
    margin = best_fragments(texts, table)[0] + bias
    return Machine(table, bias, *platt(margin, y, np.where(y > 0, *cost)))


def _runs(fragments: np.ndarray) -> list[tuple[int, ...]]:
    """The start of each fragment (as long as its positions reach), each once."""
    out = [tuple(int(x) for x in f[:FRAGMENT] if x) for f in fragments]
    return list(dict.fromkeys(z for z in out if len(z) >= N))


# ---- Spark ----------------------------------------------------------------

def fold(docs: DataFrame):
    """crc32 of the id as text modulo FOLDS; null ids count as held out."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % FOLDS, F.lit(TEST_FOLD))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: each labelled id outside the held-out fold once."""
    return (labels.filter("doc_id is not null and toxic is not null").filter(fold(labels) != TEST_FOLD)
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def class_counts(labels: DataFrame) -> tuple[int, int]:
    """Toxic and clean ids among all that are labelled outside the held-out fold."""
    row = labelled(labels).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    return row[0], row[1]


def training_texts(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[list[str], list[str]]:
    """Bounded sample of labelled texts outside the held-out fold: of each
    class the ``per_class`` ids with the smallest seeded hash, and of each id
    the one text with the smallest seeded hash."""
    wanted = labelled(labels)
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    ids = wanted.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        wanted.filter("toxic = 0").orderBy(*order).limit(per_class))
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, toxic int")   # at most 2 * per_class rows
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
            .filter(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(ids), "doc_id")
            .groupBy("toxic", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64(F.lit(11), "text"), "text")).alias("text"))
            .collect())
    rows.sort()
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Machine:
    """Machine fitted on the bounded sample, weighted to the class counts of
    all labelled rows, so it does not depend on what the sample holds of each."""
    return fit(*training_texts(docs, labels, per_class), counts=class_counts(labels))


def toxicity_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of a text without any match.  Rows
    that repeat a doc_id are scored each; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batch: pa.RecordBatch) -> dict:
        p = held.value.scores(texts_of(batch))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(p),
                "predicted": pa.array((p >= 0.5).astype(np.int32))}

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs) == TEST_FOLD).alias("held_out"),
                         docs["text"].alias("text"))
    return map_batches(source, score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, same columns."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    mark = free_name(docs, "toxic_row")

    def judge(batch: pa.RecordBatch) -> dict:
        cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        return cols | {mark: pa.array(held.value.scores(texts_of(batch)) >= threshold)}

    schema = StructType([*docs.schema.fields, StructField(mark, BooleanType())])
    return map_batches(docs, judge, schema).filter(~F.col(mark)).drop(mark)
