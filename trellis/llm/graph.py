"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its least node.

    Each round joins the links with one least neighbour for each node; both sides are tables, so Spark can split a node of
    very many links. Links between a node and itself give a component of its own. Rounds grow as the logarithm of the
    longest path.
    """
    pairs = lambda df: df.select("a", "b").filter("a <> b").distinct()
    every = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = materialise(pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialise(pairs(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        new = materialise(pairs(small), "links")
        release(edges, large)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return every.join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
