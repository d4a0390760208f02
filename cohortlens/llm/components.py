"""Connected components of a link table, as Spark joins.

Each round every node looks at the smallest node it is linked to and all
links are moved onto that node (large star, then small star).  Links shrink
to stars around the smallest node of each component in about log(diameter)
rounds; nothing but a link count comes to the driver.  Each round is written
to the shared folder, so lineage stays short and a lost executor costs one
round at most.  A round has no more links than the one before, so that count
sets the files of the next: a few thousand links are one file, not one a
shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on (a, b) links with a > b."""
    if large:   # every node hands its larger neighbours to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:       # every node hands its smaller neighbours, and itself, to its smallest neighbour
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        out = (joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.filter("a > b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that has a link; ``links``: columns a
    and b of one orderable type.  component: the smallest node reachable.
    Self links and repeated links do no harm; no links: an empty result."""
    kind = links.schema["a"].dataType
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges, name)
    n, before = edges.count(), None
    while True:
        edges = materialise(sized(_star(_star(edges, True), False), n), name)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (seen["n"], seen["s"]):
            break
        before = (seen["n"], seen["s"])
        n = seen["n"]
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = sized(found.unionByName(roots), 2 * n)
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))
