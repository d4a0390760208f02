"""The corpus pipeline end to end, each stage against a plain version on the rows
its predecessor kept, and on odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm.queries import word_tokenizer

CALM = "ane bere coli dotu ena firo gula hemi iko jura".split()
RUDE = ["you stupid idiot", "shut up moron", "dumb pathetic loser", "filthy worthless scum"]
COLUMNS = "doc_id long, text string, lang string, source string, score int"


def _calm(rng, n):
    return " ".join(rng.choice(CALM) + str(rng.randrange(90)) for _ in range(n))


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(sf_dir, rows, benchmark items): calm and rude documents, copies, near
    copies, benchmark passages, nulls, empty and repeated rows, a long text."""
    rng = random.Random(8)
    items = [(i, _calm(rng, 14)) for i in range(4)]
    texts = [(i, _calm(rng, 40)) for i in range(120)]
    texts += [(200 + i, f"{_calm(rng, 6)} {RUDE[i % 4]} {_calm(rng, 4)} {RUDE[(i + 1) % 4]}") for i in range(60)]
    texts += [(300 + i, texts[i][1]) for i in range(10)]                                    # copies
    long = _calm(rng, 4000)
    texts += [(400, long), (401, long + " end"), (402, long.replace(CALM[0] + "1 ", "zzz ", 1))]      # near copies
    texts += [(500 + i, f"{_calm(rng, 30)} {items[i][1]} {_calm(rng, 30)}") for i in range(4)]
    texts += [(600, items[0][1]), (601, None), (602, ""), (603, " \n"), (604, texts[0][1]), (604, texts[0][1]), (None, "no id at all here")]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "web", 1) for i, t in texts]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(200 <= i < 300), "en", 1) for i, _t in texts if i is not None and i < 300]
    spark.createDataFrame(labels, "doc_id long, toxic int, lang string, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Rows after every stage."""
    path, rows, _items = corpus
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), [rows]
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == docs.columns
        folder = str(tmp_path_factory.mktemp("stage")) + "/rows"
        done.write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs.collect())
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(stages):
    before, after = [Counter(map(tuple, rows)) for rows in stages[:2]]
    assert not after - before
    gone = [i for i, *_rest in (before - after).elements()]
    rude = [i for i, *_rest in before.elements() if i is not None and 200 <= i < 300]
    assert len(set(rude) & set(gone)) >= 0.9 * len(rude) and any(_held_out(i) for i in gone)
    assert not [i for i in gone if i is None or i < 200]


def test_one_of_each_text_stays(stages):
    before, after = stages[1:3]
    best = {}
    for r in before:
        text = r["text"] or ""
        best[text] = max(best.get(text, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in after) == Counter((i, t) for t, i in best.items())


def _fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_one_of_each_near_group_stays(stages):
    before, after = stages[2:4]
    prints = [_fingerprint(r["text"]) for r in before]
    group = list(range(len(before)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[top(i)] = top(j)
    where = {(r["doc_id"], r["text"]): top(i) for i, r in enumerate(before)}
    stayed = Counter(where[r["doc_id"], r["text"]] for r in after)
    assert set(stayed) == set(where.values()) and set(stayed.values()) == {1}
    assert len(after) < len(before)


def test_benchmark_passages_go(stages, corpus):
    items = corpus[2]
    before, after = [{r["doc_id"]: r["text"] for r in rows} for rows in stages[3:5]]
    assert any(i is not None and 500 <= i < 504 for i in before)
    for i, text in before.items():
        hits = [t for _k, t in items if t in (text or "")]
        if not hits:
            assert after[i] == text
        elif text in hits:
            assert i not in after                       # nothing but the item
        else:
            assert after[i] == text.replace(hits[0], "")


def test_every_token_is_packed_once(stages):
    docs, pieces = stages[4:]
    tok = Tokenizer.from_file(word_tokenizer())
    sizes = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(sizes)
    for spans, total in [*((s, sizes[i]) for i, s in by_doc.items()), *((s, None) for s in by_sequence.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048


def test_run_is_its_stages(spark, corpus, stages):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.agg({"length": "sum"}).first()[0] == sum(r["length"] for r in stages[-1])
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in stages[-1]}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, lang string, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
