"""Importance resampling, document fingerprints and the conversation trie
against brute-force versions and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import importance, minhash, prefix_trie
from cohortlens.llm.wordarrays import ALNUM_WORDS, Words, lower_ascii, utf8

WORDS = "ane bere coli dotu ena firo gula hemi iko jura".split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def _texts():
    rng = random.Random(5)
    shared = _prose(rng, 30)
    out = [(i, _prose(rng, rng.randrange(1, 60))) for i in range(40)]
    out += [(60, shared), (61, shared), (62, shared + " end"), (63, None), (64, ""), (65, " \t\n"), (66, None), (67, "one"),
            (68, _prose(rng, 20_000)), (69, "ÉTÉ Été x"), (70, "!!! ???"), (71, shared), (71, shared), (None, "lost " * 25),
            (None, None), (-5, shared.upper()), (2 ** 62, _prose(rng, 21)), (-(2 ** 62), "w" * 1000 + " z" * 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx", 1) for i, t in _texts()], "doc_id long, text string, score string, rank int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- importance resampling -------------------------------------------------

def _runs(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _bucket(run):
    return zlib.crc32(run.encode()) % 10_000


def _resampled(rows, target):
    s, t = (Counter(_bucket(f) for x in texts for f in _runs(x)[1]) for texts in ([t for _, t in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, runs = _runs(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(_bucket, runs))
        weight = total // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))))
    fits = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    for k, r in enumerate(fits[:25 * len(fits) // 100]):
        drawn[(*r, k + 1)] += 1
    left = Counter(out) - Counter({r: sum(v for d, v in drawn.items() if d[:5] == r) for r in set(out)})
    return drawn + Counter({(*r, None): n for r, n in left.items()})


@pytest.mark.parametrize("bits,block", [(11, 1 << 14), (3, 4)])
def test_resample(docs, spark, bits, block):
    target = ["ane1 bere2 coli3 " * 5, None, "", "dotu1 ena2"]
    marked = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), bits=bits, block_rows=block)
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in marked.collect())
    assert got == Counter({(r[0], *r[2:]): n for r, n in _resampled(_texts(), target).items()})


def test_resample_all_equal_and_empty(spark, none):
    text = "ane " * 30
    same = spark.createDataFrame([(7, text)] * 40 + [(None, text)] * 8, "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    rows = importance.resample(same, target, block_rows=4, bits=2).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 13)) and len(rows) == 48
    one = importance.resample(same.limit(9), target).collect()          # no digit tells the rows apart
    assert sorted(r["rank"] for r in one if r["rank"]) == [1, 2]
    assert importance.resample(none, target).count() == 0
    assert importance.resample(spark.createDataFrame([(1, "few words")], "doc_id long, text string"), target).first()["rank"] is None
    whole = importance.sample(same, target, block_rows=4, bits=2).collect()
    assert sorted(r["rank"] for r in whole) == list(range(1, 13)) and {r["text"] for r in whole} == {text}


@pytest.mark.parametrize("bits,block", [(11, 1 << 14), (4, 8)])
def test_radix_ranks_is_a_stable_sort(spark, bits, block):
    rng = random.Random(bits)
    rows = [(rng.randrange(5), rng.randrange(1 << 20), k) for k in range(500)] + [(9, 9, 1000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, k long").coalesce(1)
    got = importance.radix_ranks(df, [(F.col("a"), 9), (F.col("b"), 1 << 20)], bits, block).orderBy("rank").collect()
    want = [r for _, r in sorted(enumerate(rows), key=lambda x: (x[1][:2], x[0]))]
    assert [(r["a"], r["b"], r["k"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 801))


def test_crc_feed():
    rng = random.Random(1)
    words = ["".join(chr(rng.choice([97, 233, 0x4e00, 0x1f600])) for _ in range(rng.randrange(1, 90))) for _ in range(200)]
    w = Words([lower_ascii(utf8(" ".join(words))), b"", utf8("lone"), utf8("a b")], ALNUM_WORDS)
    bucket, row = importance.bucketed_runs(w, 3, 1 << 32)
    texts = [words, [], ["lone"], ["a", "b"]]
    want = [(zlib.crc32(" ".join(t[i:i + k]).encode()), d) for k in (1, 2, 3) for d, t in enumerate(texts) for i in range(len(t) - k + 1)]
    assert list(zip(bucket.tolist(), row.tolist())) == want


# --- fingerprints -----------------------------------------------------------

def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_compare_with_next(docs, none, spark):
    rows = [r for r in _texts() if r[0] is not None and r != (71, _texts()[-7][1])]
    got = sorted(minhash.compare_with_next(docs.filter("doc_id is not null")).collect(), key=lambda r: r["doc_id"])
    texts = sorted(((i, t or "") for i, t in _texts() if i is not None), key=lambda r: r[0])
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]
    marks = defaultdict(set)
    for k, r in enumerate(got):
        text, after = texts[k][1], texts[(k + 1) % len(texts)][1]
        edited = minhash.edited_text(text, after)
        m = len(text) // 4
        assert edited == text[:len(text) - m] + after[:m]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - _jaccard(text, edited)) < 0.2 and abs(r["near_next"] - _jaccard(text, after)) < 0.2
        assert 0 <= r["near_next"] <= 1 and (edited != text or r["near_edited"] == 1)
        marks[text].add(r["fingerprint"])
        marks[edited].add(r["edited_fingerprint"])
    assert all(len(m) == 1 for m in marks.values()) and rows
    assert minhash.compare_with_next(none).count() == 0
    alone = minhash.compare_with_next(spark.createDataFrame([(3, "abcdefgh" * 20)], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_compare_with_next_null_and_repeated_ids(docs):
    got = minhash.compare_with_next(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in _texts())


def test_signatures_are_minima_of_the_family():
    x, at = minhash.shingle_hashes(["a b c d e f g", "", "a b", None, "A B C D E"])
    assert np.diff(at).tolist() == [3, 0, 1, 0, 1] and x[0] == x[4]
    a, b = minhash._family(128, minhash.SEED)
    got = minhash.signatures(["a b c d e f g", "", "a b"])
    want = [min((int(v) * int(p) + int(q) & (1 << 64) - 1) >> 32 for v in x[:3]) for p, q in zip(a, b)]
    assert got[0].tolist() == want and (got[1] == 0xFFFFFFFF).all()


def test_near_links(spark, none):
    rng = random.Random(8)
    base = [_prose(rng, 80) for _ in range(3)]
    rows = [(i, base[i % 3] if i < 6 else base[i % 3] + f" tail{i}") for i in range(30)] + [(40, _prose(rng, 60)), (41, None), (42, ""), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = {(r["a"], r["b"]): r["jaccard"] for r in minhash.near_links(df).collect()}
    text = dict(rows)
    assert links and all(abs(v - _jaccard(text[a], text[b])) < 1e-9 and v >= 0.8 for (a, b), v in links.items())
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df).collect() if r["doc_id"] is not None}
    assert got == {i: (i % 3 if i < 30 else i if i < 42 else 41) for i in text if i is not None}
    assert minhash.near_links(none).count() == 0
    marked = minhash.fingerprint_documents(df.withColumn("fingerprint", F.lit("mine")))
    assert marked.columns == ["doc_id", "text", "fingerprint", "fingerprint_"] and len(marked.first()["fingerprint_"]) == 256


# --- conversation trie ------------------------------------------------------

def _trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    out = Counter()
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        out[min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node],
            sum(1 for n in below if not kids[n]), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _own(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}


def _rebuilt(rows):
    own = _own(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def _conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(100, 190), *range(300, 320), *range(405, 420), 0, -3, -120]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é🙂", "", None, "yes", "no", "more"])))
    rows += [(500 + c, t, "user", "same") for c in range(25) for t in range(4)] + [(None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 3])
def test_prefix_trie(spark, limit):
    """Limit 3: crowded prefixes, many shards, shared upper nodes."""
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1)).withColumn("path", F.lit("x"))
    got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(df), limit).collect())
    assert got == _trie(_rebuilt(rows))


def test_prefix_trie_long_and_empty(spark):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(prefix_trie.sequences(df), 1).collect())
    assert got == _trie(_own(rows))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(df.limit(0))).count() == 0


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 1, "ab", "c"), (2, 1, "a", "bc"), (3, 1, "a", "bc")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(df)).filter("depth = 1").count() == 2


def test_double_array():
    rng = np.random.default_rng(2)
    seqs = [tuple(rng.integers(1, 30, rng.integers(0, 7)).tolist()) for _ in range(400)]
    size = np.array([len(s) for s in seqs])
    flat = np.array([x for s in seqs for x in s], dtype=np.int64)
    array = prefix_trie.DoubleArray(flat, np.cumsum(size) - size, size)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    place = {(): 0}
    for p in sorted(prefixes, key=len):
        if p:
            place[p] = int(array.step(np.array([place[p[:-1]]]), np.array([p[-1]]))[0])
            assert place[p] > 0
    assert len(set(place.values())) == len(prefixes) == int((array.check >= 0).sum())
    for p in list(prefixes)[:100]:
        for c in range(1, 31):
            assert (int(array.step(np.array([place[p]]), np.array([c]))[0]) >= 0) == ((*p, c) in prefixes)
