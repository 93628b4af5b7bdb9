"""Connected components of a graph given as a table of edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the edges (columns a and b).

    Large and small stars in turn: each node's neighbours are linked to the smallest of them, first the larger
    neighbours, then the smaller ones, until every edge points at its root. Smallest neighbours are aggregated with
    partial sums and joined back, so that a node on which a third of all edges meet is
    no group in one task. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = durable(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
