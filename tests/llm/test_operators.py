"""Operators of the training-data subpackage against brute-force versions and
on odd input: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns."""

from __future__ import annotations

import math
import itertools
import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import (common, components, decontaminate, exact_dedup, language_id, packing, preference, sharding, simhash,
                            substring_dedup, toxicity, url_rules, wordarrays)
from cohortlens.llm.queries import word_tokenizer

WORDS = "ane bere coli dotu ena firo gula hemi iko jura".split()


def _prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def _texts() -> list[tuple]:
    rng = random.Random(3)
    shared = _prose(rng, 30)
    out = [(i, _prose(rng, rng.randrange(1, 60))) for i in range(40)]
    out += [(50 + i, _prose(rng, 9) + " " + shared + "\n" + _prose(rng, 5)) for i in range(5)]
    out += [(60, shared), (61, shared), (62, shared + " end"), (63, None), (64, ""), (65, " \t\n"), (66, None), (67, "one"),
            (68, _prose(rng, 20_000)), (69, "ÉTÉ Été x"), (70, "!!! ???"), (71, shared), (71, shared), (None, "lost"),
            (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "xx", 1) for i, t in _texts()], "doc_id long, text string, fp string, id int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup(docs, none):
    rows = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(docs).collect()}
    groups: dict[str, list] = {}
    for i, t in _texts():
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    for i, t in _texts():
        r = rows[i, hashlib.sha256((t or "").encode()).hexdigest()]
        best = max(groups[t or ""])
        assert (r["keep_id"], r["group_size"]) == (None if best < 0 else best, len(groups[t or ""]))
        assert r["kept"] == ((-1 if i is None else i) == best)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(none).count() == 0


def _fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = _words(low)
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    known = [(i, t, _fingerprint(t)) for i, t in _texts()]
    label = {fp: fp for _, _, fp in known}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least: dict[int, int] = {}
    for i, _, fp in known:
        if i is not None:
            least[label[fp]] = min(i, least.get(label[fp], i))
    want = Counter({(i, f"{fp:016x}", least.get(label[fp])): 1 for i, _, fp in known})
    got = simhash.near_duplicates(docs)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.values()))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_files_follow_rows_not_partitions(spark, docs, monkeypatch):
    """Few rows under many shuffle partitions are few files (each costs an
    executor a process); more rows are more."""
    files: dict[str, int] = {}

    def written(df, name):
        out = common.materialise(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "materialise", written)
    monkeypatch.setattr(components, "materialise", written)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        near = simhash.near_duplicates(docs.repartition(40))
        got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near.collect()}
        few = files | {"result": near.rdd.getNumPartitions()}
        chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = components.components(chain.unionByName(chain), "chain").collect()
        monkeypatch.setattr(common, "ROWS_PER_FILE", 100)
        components.components(chain, "many").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert max(few.values()) <= 2 and len(few) == 6
    assert sorted(map(tuple, found)) == [(k, 0) for k in range(301)]
    assert files["many"] >= 2


def _covered(texts, n=13):
    last = 1 << 62
    first: dict[tuple, int] = {}
    for i, t in texts:
        w = _words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, last), last if i is None else i)
    for i, t in texts:
        w, gone = _words(t), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (last if i is None else i):
                gone.update(range(k, k + n))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("limit", [1 << 18, 3])     # a tiny limit makes long prefixes
def test_substring_dedup(docs, none, limit):
    got = substring_dedup.remove_repeats(docs, limit=limit).collect()
    assert Counter(map(tuple, got)) == Counter(_covered(_texts()))
    assert sum(r["n_removed"] for r in got) > 100
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_repeats_inside_one_document(spark):
    once = " ".join(f"w{k}" for k in range(13))
    rows = [(5, once + " " + once), (5, once), (9, once + " tail")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(_covered(rows))


def test_substring_steps_take_few_passes():
    """Array steps against plain versions; a window sorts by a few packed columns,
    hashes of whole windows are made only where they are read."""
    rng = random.Random(5)
    texts = [t for _, t in _texts()] + ["", " a ", "ü" * 300 + "\tß  end \n", "x" * 70_000 + " y"] * 2
    scan = substring_dedup.Scan(texts, 13)
    assert "whole" not in vars(scan) and len(scan.whole) == len(scan.start) > 0
    mask = (1 << 64) - 1
    for k in [*range(40), *range(len(scan.words) - 4, len(scan.words))]:
        word = scan.words.word(k)
        x = sum((b + 1) * pow(wordarrays._P1 | 1, i, 1 << 64) for i, b in enumerate(word)) & mask
        x ^= len(word) * wordarrays._P2 & mask
        assert int(scan.codes[k]) == int(wordarrays.mix(np.array([x], np.uint64))[0]) >> 16
    values = np.array([rng.randrange(1 << 64) for _ in range(50)], np.uint64)
    for width in (1, 2, 3, 10, 13):
        got = substring_dedup.sliding_min(values, width).tolist()
        assert got == [min(values[k:k + width].tolist()) for k in range(50)]
    gone = np.array([rng.random() < 0.5 for _ in range(len(scan.words))])
    plain = [" ".join(scan.words.word(k).decode() for k in range(lo, hi) if not gone[k])
             for lo, hi in itertools.pairwise(scan.words.doc_first.tolist())]
    assert substring_dedup._kept(scan.words, gone).to_pylist() == plain
    assert substring_dedup._kept(scan.words, ~np.zeros_like(gone)).to_pylist() == [""] * len(texts)
    codes = np.array([rng.randrange(1 << 48) for _ in range(300)], np.uint64)[[rng.randrange(300) for _ in range(2000)]]
    start = np.arange(len(codes) - 12)
    columns = substring_dedup.packed_columns(codes, start, 13)
    assert len(columns) == 2            # 300 codes: 9 bits, 7 of them a column
    plain = sorted(start.tolist(), key=lambda k: (codes[k:k + 13].tolist(), k))
    assert np.lexsort(columns[::-1]).tolist() == plain
    wide = substring_dedup.packed_columns(np.array([7, 9, 7, 8], np.uint64), np.array([0, 2]), 2)
    assert wide.shape == (1, 2) and wide[0, 0] > wide[0, 1]


@pytest.mark.parametrize("limit", [8, substring_dedup.GROUP_SUFFIXES])
def test_substring_spans_are_maximal(spark, docs, limit):
    want = Counter()
    texts = _texts()
    order = {None: (1, 0)}
    starts: dict[tuple, list] = {}
    for i, t in texts:
        w = _words(t)
        for p in range(len(w) - 12):
            starts.setdefault(tuple(w[p:p + 13]), []).append(order.get(i, (0, i)))
    for i, t in texts:
        w = _words(t)
        gone = [False] * (len(w) + 1)
        for p in range(len(w) - 12):
            if min(starts[tuple(w[p:p + 13])]) < order.get(i, (0, i)):
                gone[p:p + 13] = [True] * 13
        p = 0
        while p < len(w):
            if gone[p]:
                end = gone.index(False, p)
                want[i, p, end - p] += 1
                p = end
            p += 1
    got = Counter(tuple(r) for r in substring_dedup.repeated_spans(docs, limit=limit).collect())
    assert got == want and max(k[2] for k in got) >= 30


@pytest.mark.parametrize("same", [None, 7])
def test_substring_rows_of_one_id_stay_linear(spark, same):
    """200 rows of one id: what is gathered for a row is as long as its own text."""
    rng = random.Random(12)
    common = _prose(rng, 40)
    rows = [(1, common)] + [(same, common + " " + _prose(rng, 60) + f" end{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    covered = substring_dedup.covered_words(substring_dedup._narrow(df)).collect()
    assert len(covered) == 201 and max(len(r["windows"] or ()) for r in covered) <= 28
    got = substring_dedup.remove_repeats(df).collect()
    assert Counter(r["n_removed"] for r in got) == Counter({0: 1, 40: 200})


@pytest.mark.parametrize("block_words", [200_000, 4])
def test_decontamination(spark, docs, none, block_words):
    items = [(1, " ".join(_words(_texts()[40][1])[9:25])), (2, "One"), (3, None), (4, "."), (None, "lost")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: token.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = lower(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(i)
    want = Counter()
    for i, t in _texts():
        w, hit, found = lower(t), set(), set()
        for key, owners in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k:k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    found |= {str(o) for o in owners if o is not None}
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, decontaminate.contamination(docs, bench, block_words=block_words).collect())) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert not decontaminate.contamination(docs, none.withColumnRenamed("doc_id", "item_id")).filter("contaminated").count()
    left = decontaminate.remove_contamination(docs, bench, block_words=block_words)
    assert left.columns == docs.columns
    assert (Counter(map(tuple, left.collect()))
            == Counter(map(tuple, decontaminate.remove_contamination(docs, bench).collect())))


def test_automata_stay_within_their_words(spark):
    rng = random.Random(4)
    items = [(i, _prose(rng, 30)) for i in range(20)] + [(99, _prose(rng, 300))]
    bench = spark.createDataFrame(items * 2, "item_id long, text string")
    blocks = decontaminate.build_automata(bench, block_words=50).collect()
    assert len(blocks) > 10 and len({r["block"] for r in blocks}) == len(blocks)
    sizes = [max(pickle.loads(r["automaton"]).length) for r in blocks]
    assert max(sizes) <= 50 + decontaminate.WINDOW - 1
    docs = spark.createDataFrame([(1, items[-1][1]), (2, "no such words")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench, block_words=50).collect()}
    assert got == {1: (300, 1), 2: (0, 0)}


def test_packing(docs, none):
    rows = packing.pack(docs, word_tokenizer()).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_tokenizer())
    sizes = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in _texts())
    pieces: dict = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert set(pieces) == set(sizes)
    for key, cut in pieces.items():
        assert sum(n for _, n in cut) == key[1] * sizes[key]
    fills: dict = {}
    for r in rows:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for cut in fills.values():
        at = 0
        for offset, length in sorted(cut):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, word_tokenizer()).count() == 0


def test_sharding(spark, docs, none, tmp_path):
    rows = sharding.shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in _texts())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots: dict[int, list] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).count() == 0
    many = sharding.place_rows(spark.range(5000).repartition(3), shards=7, bucket_rows=64).collect()
    assert sorted(r["id"] for r in many) == list(range(5000))
    assert len({(r["shard"], r["slot"]) for r in many}) == 5000
    assert [r["id"] for r in sorted(many, key=lambda r: (r["slot"], r["shard"]))][:50] != list(range(50))
    back = sharding.write_shards(docs, str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(_texts())


def test_sharding_answers_from_whole_rows_in_the_shards(spark, docs, tmp_path):
    """The columns come from the shard files, and these hold every row whole."""
    got = sharding.shard_documents(docs, path=str(tmp_path / "shards"))
    files = got.inputFiles()
    assert files and all(f"{tmp_path}/shards/shard=" in f for f in files)
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"], r["fp"], r["id"]) for r in stored.collect()) == Counter((i, t, "xx", 1) for i, t in _texts())
    assert Counter((r["shard"], r["slot"], r["size"]) for r in got.collect()) == Counter(
        (r["shard"], r["slot"], len((r["text"] or "").encode()) + 1) for r in stored.collect())
    for f in files:                                               # each file in slot order
        slots = [r["slot"] for r in spark.read.parquet(f).collect()]
        assert slots == sorted(slots)


def test_sharding_of_columns_named_like_its_own(spark, tmp_path):
    rows = [(k, f"text {k}", 70 + k, f"s{k}", k * 0.5) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long, Slot string, slot_ double")
    got = sharding.shard_documents(df, path=str(tmp_path / "shards")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(30)) and {r["shard"] for r in got} == set(range(8))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"], r["shard_"], r["Slot__"], r["slot_"]) for r in back.collect()) == rows


def test_sharding_buckets_by_bytes(spark, docs):
    """A long text alone, the others by bytes as well as by rows."""
    buckets = [[r["row"]["text"] or "" for r in b["rows"]] for b in sharding.fill_buckets(docs, bucket_bytes=2000).collect()]
    assert sorted(t for b in buckets for t in b) == sorted(t or "" for _, t in _texts())
    long = [b for b in buckets if any(len(t) > 50_000 for t in b)]
    assert [len(b) for b in long] == [1] and len(buckets) > 5
    nested = spark.createDataFrame([(1, {"a": 1}, ["x"]), (2, None, None)], "doc_id long, m map<string,int>, a array<string>")
    assert sorted(r["doc_id"] for r in sharding.place_rows(nested).collect()) == [1, 2]


def _verdicts(rows):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows.collect()}


def _ranked(rules):
    return [(r["tokens"], r["verdict"]) for r in rules.orderBy("place").collect()]


def test_url_rules(spark):
    urls = [(1, "http://a.Example.ORG/es/1?x=/en/"), (2, "https://example.org/en/17"), (3, "https://x.org"), (4, None), (5, "nothing"),
            (6, "http://b.com/de/?q"), (7, "http://notcom/fr/"), (8, "http://b.com/fr/#y"), (9, "http://bad.net/junk/7"),
            (10, "http://good.net/fine/7"), (11, ""), (12, "http://com/de/")]
    known = [(100 + k, f"http://{'bad' if k % 2 else 'good'}.net/{'junk' if k % 2 else 'fine'}/{k}") for k in range(100)]
    pages = spark.createDataFrame(urls + known, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in known] + [(None, 1), (1, None)], "doc_id long, quality int")
    table = url_rules.mine_rules(pages, labels)
    rules = _ranked(table)
    assert rules and {v for _, v in rules} == {"allow", "block"}
    got = _verdicts(url_rules.judge_urls(pages, table))
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[3] == ("x.org", "", None, "allow")
    assert got[4] == got[5] == got[11] == ("", "", None, "allow")
    assert got[6][2:] == got[12][2:] == ("com/de/", "block")
    assert got[7][2] is None and got[8][2:] == ("com/fr/", "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    # brute force: the first rule whose tokens are all there
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    for i, (_, _, rule, verdict) in got.items():
        if rule is None:
            assert verdict == next((v for need, v in rules if set(need) <= tokens[i]), "allow")
    assert url_rules.mine_rules(pages.limit(0), labels).count() == 0
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0
    assert {v[3] for v in _verdicts(url_rules.judge_urls(pages, table.limit(0))).values() if v[2] is None} == {"allow"}


def _labelled(spark):
    """Pages of few tokens, their baskets, labels that follow from token pairs, and a rare bad token."""
    rng = random.Random(6)
    urls, quality = [], []
    for k in range(700):
        a, b, c = rng.choice("pqr"), rng.choice("xyz"), rng.choice("uv")
        rare = k % 28 == 0
        urls.append((k, f"http://{a}.{'rare' if rare else 'net'}/{b}/{c}/{k}"))
        quality.append((k, int(not (rare or (a == "p" and b == "x") or rng.random() < 0.1))))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    tokens = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    return pages, spark.createDataFrame(quality, "doc_id long, quality int"), [(tokens[k], "allow" if q else "block") for k, q in quality]


def test_url_rules_are_all_frequent_itemsets(spark):
    """Plain enumeration of every combination of tokens, then of the rare single ones."""
    pages, labels, baskets = _labelled(spark)
    n, share = len(baskets), Counter(v for _, v in baskets)
    seen, hits = Counter(), Counter()
    for tokens, v in baskets:
        for size in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), size):
                seen[some] += 1
                hits[some, v] += 1
    want = {}
    for (some, v), h in hits.items():
        confidence, base = h / seen[some], share[v] / n
        frequent = h >= 0.05 * n and confidence >= 0.8 and confidence > base
        z, m = url_rules.Z, seen[some]
        bound = (confidence + z * z / (2 * m) - z * math.sqrt(confidence * (1 - confidence) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        rare = len(some) == 1 and 20 <= h < 0.05 * n and confidence >= 0.8 and bound > base
        if frequent or rare:
            want[some] = (-confidence, -h / n, len(some), v)
    kept = {s: w for s, w in want.items()
            if not any(set(o) < set(s) and (x[:3], " ".join(o)) < (w[:3], " ".join(s)) for o, x in want.items())}
    table = url_rules.mine_rules(pages, labels, min_support=0.05)
    got = {tuple(r["tokens"]): (r["place"]["doubt"], r["place"]["support"], r["place"]["n_tokens"], r["verdict"]) for r in table.collect()}
    assert set(got) == set(kept) and len(kept) < len(want)
    for some, w in kept.items():
        assert got[some][3] == w[3] and got[some][:3] == pytest.approx(w[:3])
    assert ("host=rare",) in got and got[("host=rare",)][3] == "block"
    # pruned rules decide as all of them would
    ranked = [(set(s), w[3]) for s, w in sorted(want.items(), key=lambda e: (e[1][:3], " ".join(e[0])))]
    verdicts = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, table, stated=[]).collect()}
    assert verdicts == {k: next((v for need, v in ranked if need <= t), "allow") for k, (t, _) in enumerate(baskets)}
    assert any(v == "block" for v in verdicts.values())


def test_rules_are_no_literals_of_the_plan(spark):
    pages, labels, _ = _labelled(spark)
    plan = url_rules.judge_urls(pages, url_rules.mine_rules(pages, labels))._jdf.queryExecution().toString()
    assert "rare" not in plan and "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_preference(spark):
    turn = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, "assistant", "two"), (1, 4, "user", "bye"),
            (1, 3, "assistant", "two"), (2, 0, "user", "alone"), (3, 0, None, "x"), (3, 1, "assistant", ""), (None, 1, "assistant", "n")]
    frame = spark.createDataFrame(rows, turn).withColumn("chosen", F.lit(1))
    got = {r["conv_id"]: r for r in preference.format_preferences(preference.preference_pairs(frame)).collect()}
    assert set(got) == {1, 3, None}
    head, tail = "<|im_start|>", "<|im_end|>\n"
    assert got[1]["prompt"] == f"{head}user\nhi{tail}{head}assistant\none{tail}{head}user\n{tail}"
    assert got[1]["chosen"] == f"{head}assistant\ntwo{tail}" and got[1]["rejected"] == f"{head}assistant\none{tail}"
    for side, text in (("chosen", "two"), ("rejected", "one")):
        (start, length), = got[1][f"{side}_spans"]
        assert got[1][side][start:start + length] == text + tail
    assert got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["n_prompt_turns"] == 2     # both replies are empty
    assert preference.format_preferences(preference.preference_pairs(frame.limit(0))).count() == 0


def test_preference_rows_without_conversation_are_not_grouped(spark):
    rows = [(None, k, "assistant", f"r{k}") for k in range(50)] + [(None, 1, "user", "x"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.format_preferences(preference.preference_pairs(frame)).collect()
    alone = [r for r in got if r["conv_id"] is None]
    assert len(alone) == 50 and len(got) == 51 and all(r["n_prompt_turns"] == 0 and r["prompt"] == "" for r in alone)
    assert {r["chosen"] for r in alone} == {f"<|im_start|>assistant\nr{k}<|im_end|>\n" for k in range(50)}


def test_preference_common_prefix(spark):
    kind = "pair int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    a, b, c = ("user", "a"), ("assistant", "b"), ("assistant", "c")
    pairs = [(1, [a, b], [a, c, a]), (2, [a, b, a], [a, b]), (3, [b], [c]), (4, None, [a]), (5, [], []), (6, [a, b], [a, b])]
    got = {r["pair"]: r for r in preference.format_preferences(spark.createDataFrame(pairs, kind)).collect()}
    assert {p: r["n_prompt_turns"] for p, r in got.items()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 2}
    for p, x, y in pairs:
        show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns or [])
        assert got[p]["prompt"] + got[p]["chosen"] == show(x) and got[p]["prompt"] + got[p]["rejected"] == show(y)


def test_language_id(spark, none):
    rng = random.Random(5)
    make = {"aa": "abcde", "zz": "vwxyz"}
    rows = [(i, "".join(rng.choice(make[lang] + " ") for _ in range(rng.randrange(20, 700))), lang)
            for i, lang in enumerate(["aa", "zz"] * 80)]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 !", "zz"), (903, "a", "aa"), (None, "abc abc abc", None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    net = language_id.train(language_id.training_rows(frame))
    got = {r["doc_id"]: r for r in language_id.identify(frame, net).collect()}
    assert len(got) == len(rows) + len(odd)
    tested = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert tested and all(got[i]["held_out"] for i, _ in tested)
    assert sum(got[i]["lang_pred"] == lang for i, lang in tested) >= 0.95 * len(tested)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(none, net).count() == 0
    untaught = language_id.train(language_id.training_rows(frame.limit(0)))
    assert {r["lang_pred"] for r in language_id.identify(frame, untaught).collect()} == {"und"}


def test_language_needs_a_letter(spark, none):
    rows = [(k, t, "aa" if k % 2 else "zz") for k, t in enumerate(["abc abc", "xyz xyz"] * 20)]
    odd = [(900 + k, t, None) for k, t in enumerate(["²", "½ ¾", "①", "Ⅷ", "1²", "__ 7"])]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    net = language_id.train(language_id.training_rows(frame))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame, net).collect()}
    assert {got[900 + k] for k in range(len(odd))} == {"und"} and "und" not in {got[k] for k, *_ in rows}


def test_language_sample_is_not_filled_by_copies(spark):
    rows = [(k, f"text number {k}", "aa") for k in range(600)]
    rows += [(1000 + k, text, "aa") for text in ("copy of one", "copy of two") for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_rows(frame, 50)
    assert len(sample) == len(set(sample)) == 50


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 4, 253, 256, 257, 509, 510, 2000):
        data = bytes(1 + k % 250 for k in range(n))
        cut = language_id.windows_of(data)
        step = language_id.WINDOW - 3
        assert b"".join(bytes(w[:step]) for w in cut[:-1]) + bytes(cut[-1]).rstrip(b"\0") == data


def test_toxicity(spark, none):
    rng = random.Random(9)
    texts = []
    for i in range(300):
        words = _prose(rng, rng.randrange(5, 80)).split()
        if i % 3 == 0:
            insult = rng.choice(["vornish", "grumbolt"])
            if rng.random() < 0.5:
                k = rng.randrange(1, len(insult) - 1)
                insult = insult[:k] + rng.choice("xq") + insult[k:]
            words.insert(rng.randrange(len(words)), insult)
        texts.append((i, " ".join(words)))
    odd = [(900, None), (901, ""), (902, "x" * 30_000), (None, "ane")]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts] + [(None, 1), (900, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, machine).collect()}
    tested = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert tested and all(got[i]["held_out"] for i in tested)
    assert sum(got[i]["predicted"] == (i % 3 == 0) for i in tested) >= 0.9 * len(tested)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert toxicity.toxicity_scores(none, machine).count() == 0
    left = toxicity.drop_toxic(docs, machine)
    assert left.columns == docs.columns
    assert left.count() == sum(not r["predicted"] for r in got.values())
    assert toxicity.fit([], ["a"]).scores(["a", None])[0] < 0.5


def test_toxicity_keeps_the_true_share_when_capped(spark):
    """A word in every toxic and in every second clean text: toxic in one of
    eight texts that have it, whatever share of toxic texts is fitted on."""
    rng = random.Random(4)
    rows = [(i, " ".join([_prose(rng, 12), *["vornish"] * (i % 4 in (0, 1)), _prose(rng, 12)]), int(i % 16 == 0)) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    with_word = [t for i, t, toxic in rows if "vornish" in t]
    share = sum(toxic for _, t, toxic in rows if "vornish" in t) / len(with_word)
    toxic, clean = toxicity.training_texts(docs, labels, 60)
    assert len(toxic) == len(clean) == 60                          # both caps bind
    got = toxicity.train(docs, labels, 60).scores(with_word)
    assert got.mean() < 0.3 and abs(got.mean() - share) < 0.08
    assert (got >= 0.5).mean() < 0.1
    assert toxicity.class_costs(45, 284, (45, 284)) == (1.0, 1.0)  # uncapped: as without weights


def test_toxicity_training_takes_one_text_an_id(spark):
    """An id with thousands of texts is one text, and drives no toxic one out."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:6]
    rows = [(ids[0], f"clean text {k}") for k in range(200)] + [(i, f"text of {i}") for i in ids[1:]]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k >= 3)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    toxic, clean = toxicity.training_texts(docs, labels, 3)
    assert toxic == [f"text of {i}" for i in ids[3:]]
    assert len(clean) == 3 and clean[0].startswith("clean text") and clean[1:] == [f"text of {i}" for i in ids[1:3]]
    assert (toxic, clean) == toxicity.training_texts(docs.repartition(5), labels, 3)
