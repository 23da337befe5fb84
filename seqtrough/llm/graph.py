"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Links from which on a star may be too large for a task.
HEAVY = 10_000


def _with_least(links: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``links`` (a, b) joined with ``least`` (a, m). A stored table meets them in a plain join of two shuffles, whose skewed parts Spark splits."""
    return links.join(stored(least) if n_links >= HEAVY else least, "a")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, any direction) to (node, label): label is the smallest node of the component.

    Each round joins the links with each node's smallest neighbour, which shrinks every tree's height; it
    ends when a round changes nothing, after about the logarithm of the longest path. Nodes without a link
    to another node are absent. Rounds are written to the shared folder, nothing is collected. The links of a star
    that holds a large share of all are dealt out: see ``_with_least``.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n_links = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both.where("b > a"), least, n_links).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least, n_links)
        pair = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")
        edges = stored(small.select(pair).select("p.a", "p.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n_links = now, now[0]
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return labels.unionByName(roots)
