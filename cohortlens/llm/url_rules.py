"""URL filtering by association rules.

Labelled pages become baskets of URL tokens plus their label; Spark's
FP-growth mines the token combinations, and rules ``tokens -> label`` are
kept by support and confidence.  A combination must lie in ``MIN_SUPPORT`` of the
labelled pages, which bounds the itemsets whatever the number of pages.  That
share grows with the corpus, so single tokens below it are counted as well, and
make rules from ``MIN_PAGES`` pages on if the lower bound of their confidence
beats their verdict's share.

Rules are a table, indexed under their rarest token, so a URL only meets rules
whose rarest token it has.  Stated (host, path) rules go first.  Everything runs
on DataFrame functions; no rule passes through the driver or into a plan.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: (verdict, host, path)
STATED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
          ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MIN_SUPPORT = 0.01
MIN_PAGES = 20           # labelled pages a rule must rest on
MIN_CONFIDENCE = 0.8
Z = 1.96                 # of the lower bound of a rare token's confidence (Wilson's, 95 %)
RULES = ("tokens array<string>, verdict string, token string, "
         "place struct<doubt:double, support:double, n_tokens:int, text:string>")
DEFAULT = "allow"
_MARK = "label="
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for urls without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.regexp_extract(url, _URL, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels (host=), path segments and query keys
    (path=, query=), with every run of digits written as 0."""
    host, path = url_parts(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)

    def marked(parts: Column, mark: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""),
                           lambda p: F.concat(F.lit(mark), F.regexp_replace(p, "[0-9]+", "0")))

    keys = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    return F.array_distinct(F.concat(marked(F.split(host, r"\."), "host="), marked(F.split(path, "[/.]"), "path="),
                                     marked(keys, "query=")))


def _ordered(found: DataFrame) -> DataFrame:
    """tokens, verdict and ``place``: rules are tried by falling confidence, falling
    support, number of tokens and their text; the least place goes first."""
    return found.select("tokens", "verdict", F.struct(
        (-F.col("confidence")).alias("doubt"), (-F.col("support")).alias("support"), F.size("tokens").alias("n_tokens"),
        F.concat_ws(" ", "tokens", "verdict").alias("text")).alias("place"))


def _lower_bound(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of the share hits / n."""
    n = n.cast("double")
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _rare_rules(baskets: DataFrame, n: int, below: float, min_pages: int, min_confidence: float, z: float) -> DataFrame:
    """Rules of one token that lies, with its label, in ``min_pages`` pages but in fewer than ``below``."""
    mark = F.element_at("items", -1)
    per = (baskets.select(F.explode("items").alias("token"), mark.alias("mark")).groupBy("token")
           .agg(F.count(F.lit(1)).alias("pages"), *[F.count(F.when(F.col("mark") == _MARK + v, 1)).alias(v) for v in ("allow", "block")]))
    share = {r["mark"]: r["n"] / n for r in baskets.groupBy(mark.alias("mark")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two labels
    sides = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("hits"), F.lit(share.get(_MARK + v, 0.0)).alias("share"))
                                for v in ("allow", "block")])).alias("s")
    return (per.filter((F.col("pages") >= min_pages) & ~F.col("token").startswith(_MARK)).select("token", "pages", sides)
            .filter((F.col("s.hits") >= min_pages) & (F.col("s.hits") < below)
                    & (F.col("s.hits") >= min_confidence * F.col("pages"))
                    & (_lower_bound(F.col("s.hits"), F.col("pages"), z) > F.col("s.share")))
            .select(F.array("token").alias("tokens"), F.col("s.verdict").alias("verdict"),
                    (F.col("s.hits") / F.col("pages")).alias("confidence"), (F.col("s.hits") / F.lit(n)).alias("support")))


def _indexed(rules: DataFrame, single: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the rarest of their tokens (ties: the least)."""
    each = rules.select("*", F.explode("tokens").alias("token")).join(single, "token", "left")
    first = F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("token"))).alias("_f")
    return (each.groupBy("place").agg(F.first("tokens").alias("tokens"), F.first("verdict").alias("verdict"), first)
            .select("tokens", "verdict", F.col("_f.token").alias("token"), "place"))


def _met(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """``subjects`` (with an array ``tokens``) joined to the rules (``rule``) all of whose
    tokens they have, over the index."""
    rule = rules.select(F.col("token").alias("_t"), F.struct("place", "verdict", "tokens").alias("rule"))
    return (subjects.select("*", F.explode("tokens").alias("_t")).join(rule, "_t").drop("_t")
            .filter(F.size(F.array_except(F.col("rule.tokens"), F.col("tokens"))) == 0))


def drop_unreached(rules: DataFrame) -> DataFrame:
    """Rules without those that hold all tokens of an earlier one: that one decides first."""
    late = (_met(rules.select("tokens", F.col("place").alias("at")), rules).filter(F.col("rule.place") < F.col("at"))
            .select(F.col("at").alias("place")).distinct())
    return rules.join(late, "place", "left_anti").select("tokens", "verdict", "token", "place")


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, z: float = Z) -> DataFrame:
    """A written table of rules: ``tokens`` (sorted), ``verdict``, ``token`` (their index)
    and ``place`` (the least is tried first).

    Labels: ``doc_id`` names the page, quality 1 allows and 0 blocks; nulls
    are left out.  A rule's confidence must also exceed its verdict's share
    of the labelled pages, else it says nothing.  No labelled page: no rules."""
    spark = pages.sparkSession
    marks = (labels.filter("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    mark = F.when(F.col("quality") > 0, F.lit(_MARK + "allow")).otherwise(F.lit(_MARK + "block"))
    baskets = materialise(pages.select(pages["page_id"].alias("doc_id"), pages["url"].alias("url")).join(marks, "doc_id")
                          .select(F.array_append(url_tokens(F.col("url")), mark).alias("items")), "op3-baskets")
    n = baskets.count()
    if n < max(min_pages, 1):
        return spark.createDataFrame([], RULES)
    share = min(1.0, max(min_support, min_pages / n))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    frequent = (model.associationRules.filter(F.col("consequent")[0].startswith(_MARK))
                .filter((F.col("lift") > 1) & ~F.exists("antecedent", lambda t: t.startswith(_MARK)))
                .select(F.array_sort("antecedent").alias("tokens"),
                        F.substring(F.col("consequent")[0], len(_MARK) + 1, 99).alias("verdict"), "confidence", "support"))
    rare = _rare_rules(baskets, n, share * n, min_pages, min_confidence, z)
    found = materialise(_indexed(_ordered(frequent.unionByName(rare)), single), "op3-found")
    rules = materialise(drop_unreached(found), "op3-rules")
    let_go(spark, baskets, found)
    return rules


def _stated_rule(host: Column, path: Column, stated: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest fitting rule, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in stated]
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def judge_urls(pages: DataFrame, rules: DataFrame,
               stated: list[tuple[str, str, str]] = STATED) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    A stated rule's verdict, else that of the best mined rule, else DEFAULT.
    Null urls, and urls without ``://``, have empty host and path and take
    DEFAULT; repeated rows are judged each; an empty table gives no rows.

    Mined rules are sought once for each different url without a stated rule.  Their
    table is broadcast only below Spark's size limit, else both sides are shuffled by
    token, where Spark splits skewed tokens."""
    host, path = url_parts(pages["url"])
    parts = pages.select("page_id", pages["url"].alias("url"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("hit", _stated_rule(F.col("host"), F.col("path"), stated))
    open_urls = parts.filter(F.col("hit").isNull() & F.col("url").isNotNull()).select("url").distinct()
    best = (_met(open_urls.select("url", url_tokens(F.col("url")).alias("tokens")), rules)
            .groupBy("url").agg(F.min(F.struct("rule.place", "rule.verdict"))["verdict"].alias("mined")))
    judged = parts.join(best, "url", "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.col("mined"), F.lit(DEFAULT))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
