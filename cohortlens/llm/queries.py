"""The registered queries of the subpackage, with production parameters over
whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, importance, language_id, minhash, packing, preference, prefix_trie, sharding, simhash,
               substring_dedup, toxicity, url_rules)
from .common import read_table


def word_tokenizer() -> str:
    """Vocabulary file of the public word-level BPE tokenizer."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, "word_bpe_49k.json")
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_tokenizer())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.mine_rules(pages, read_table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "copies")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(language_id.training_rows(docs)))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply; spans as ``start:length`` lists."""
    made = preference.format_preferences(preference.preference_pairs(read_table(spark, sf_dir, "conversations")))
    for c in ("chosen_spans", "rejected_spans"):
        made = made.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["length"])), ","))
    return made


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(read_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_url_rules": op3_url_rules,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_preference": op9_preference,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_fingerprints": op12_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
}

# zlib's crc32 in SQL: its table from the polynomial, then a byte a step
_CRC = """
        crc AS (SELECT list(v ORDER BY n) AS t FROM (
                    SELECT n, list_reduce(list_prepend(n, range(8)),
                                          lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
                    FROM (SELECT unnest(range(256)) AS n)))"""


def _crc32(value: str) -> str:
    byte = f"CAST('0x' || substr(hex({value}), 2 * i + 1, 2) AS BIGINT)"
    bytes_ = f"list_transform(range(strlen({value})), lambda i: {byte})"
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_}), "
            f"lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)")


ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256,
               count(*) AS copies
        FROM t JOIN g USING (text_sha256) GROUP BY ALL""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
             x AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM s),
             g AS (SELECT h, min(doc_id) AS low FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
             gone AS (SELECT DISTINCT x.doc_id, unnest(range(x.p, x.p + 13)) AS p FROM x JOIN g USING (h) WHERE x.doc_id > g.low),
             every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
             kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
                      FROM every e ANTI JOIN gone USING (doc_id, p) GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # the pair of a conversation: its last reply against the reply before it
    "op9_preference": """
        WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
                   FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
                         FROM conversations)),
             k AS (SELECT conv_id, max(rn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
             j AS (SELECT t.conv_id, max(t.rn) AS prior FROM t JOIN k USING (conv_id)
                   WHERE t.role = 'assistant' AND t.rn < k.last GROUP BY t.conv_id),
             p AS (SELECT k.conv_id, k.last, a.text AS good, coalesce(b.text, '') AS bad, a.text = coalesce(b.text, '') AS same
                   FROM k LEFT JOIN j USING (conv_id) JOIN t a ON a.conv_id = k.conv_id AND a.rn = k.last
                   LEFT JOIN t b ON b.conv_id = k.conv_id AND b.rn = j.prior),
             s AS (SELECT p.conv_id, string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), ''
                                                ORDER BY t.rn) AS prompt
                   FROM p JOIN t ON t.conv_id = p.conv_id AND (t.rn < p.last OR p.same AND t.rn = p.last) GROUP BY p.conv_id),
             f AS (SELECT p.*, coalesce(s.prompt, '') AS prompt, '<|im_start|>assistant' || chr(10) AS head,
                          '<|im_end|>' || chr(10) AS tail FROM p LEFT JOIN s USING (conv_id))
        SELECT conv_id, CAST(CASE WHEN same THEN last ELSE last - 1 END AS INTEGER) AS n_prompt_turns, prompt,
               CASE WHEN same THEN '' ELSE head || good || tail END AS chosen,
               CASE WHEN same THEN '' ELSE head || bad || tail END AS rejected,
               CASE WHEN same THEN '' ELSE length(head) || ':' || (length(good) + length(tail)) END AS chosen_spans,
               CASE WHEN same THEN '' ELSE length(head) || ':' || (length(bad) + length(tail)) END AS rejected_spans
        FROM f""",
    "op11_importance": rf"""
        WITH {_CRC},
             d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             df AS (SELECT row, f, count(*) AS n FROM (SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)),
                           lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY row, f),
             bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)),
                           lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY f),
             k AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
             s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY bucket),
             u AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
             g AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT sum(s) FROM s) + 10000.0)
                          / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (coalesce((SELECT sum(t) FROM u), 0) + 10000.0)))) AS gain
                   FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN u USING (bucket)),
             w AS (SELECT row, sum(n) AS features, floor(sum(n * gain) / sum(n)) AS weight
                   FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY row),
             x AS (SELECT row, doc_id, len(w) AS n_words, CAST(coalesce(features, 0) AS BIGINT) AS n_features,
                          CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                          CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE))) AS BIGINT) AS noise
                   FROM d LEFT JOIN w USING (row)),
             r AS (SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, row) AS place, count(*) OVER () AS n
                   FROM x WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
        FROM x LEFT JOIN r USING (row)""",
    "op13_prefix_trie": f"""
        WITH {_CRC},
             o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
                          ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h
                   FROM (SELECT DISTINCT conv_id FROM o), crc),
             r AS (SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = c.base AND p <= h
                   UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND p > h),
             q AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY p) AS k, list(length(text) ORDER BY p) AS chars
                   FROM r GROUP BY conv_id),
             m AS (SELECT c.conv_id, coalesce(k, []) AS k, coalesce(chars, []) AS chars FROM c LEFT JOIN q USING (conv_id)),
             e AS (SELECT conv_id, k, chars, unnest(range(len(k) + 1)) AS depth FROM m),
             n AS (SELECT sha256(array_to_string(k[1:depth], '')) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                          arg_min(k[1:depth], conv_id) AS path, any_value(chars[depth]) AS last,
                          string_agg(CASE WHEN len(k) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
                   FROM e GROUP BY node, depth),
             a AS (SELECT *, CASE WHEN depth > 0 THEN sha256(array_to_string(path[1:depth - 1], '')) END AS up FROM n),
             kids AS (SELECT up AS node, count(*) AS n_children FROM a WHERE up IS NOT NULL GROUP BY up),
             z AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN kids USING (node)),
             below AS (SELECT sha256(array_to_string(path[1:i], '')) AS node, n_children, (n_convs - 1) * coalesce(last, 0) AS saved
                       FROM (SELECT *, unnest(range(depth + 1)) AS i FROM z)),
             sums AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY node)
        SELECT z.conv_id, z.depth, up.conv_id AS parent_conv_id, z.n_convs, z.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
               sha256(coalesce(z.ends, '')) AS ends_sha256
        FROM z JOIN sums USING (node) LEFT JOIN a AS up ON up.node = z.up""",
}
