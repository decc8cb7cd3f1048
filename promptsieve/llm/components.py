"""Connected components over links, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest linked node.

    Each round moves links to smaller neighbours (large star, then small star) until every
    component is one star. The number of rounds grows with the logarithm of the number of
    nodes. No neighbour list is gathered: a round is a minimum per node, joined back.
    """
    edges = saved(
        links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(),
        "links")
    state = None
    while True:
        both = edges.union(edges.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("m"))
        large = (
            both.where("other > node").join(least, "node")
            .select(F.col("m").alias("low"), F.col("other").alias("high")).where("low <> high").distinct()
        )
        # Small star: every node's smaller neighbours and the node itself go to the least of them.
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = (
            large.join(least, "high").select(F.col("m").alias("low"), F.col("low").alias("high"))
            .union(least.select(F.col("m").alias("low"), "high")).where("low <> high").distinct()
        )
        edges = saved(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
