"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of edges (a, b).

    Alternates large-star and small-star steps: each node's larger, then smaller, neighbours are
    linked to its smallest one, until every edge points at a root. Each step is a minimum by
    node and a join with it, so no neighbourhood is gathered; rounds grow with the logarithm
    of the longest chain. Each round is written, which cuts its lineage.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = frames.written(links, "links")
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour of a node is linked to the least in the node's neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = frames.written(small, "links")
        # done when the edges are stars: each node has one edge, to a node that has none to a smaller one
        roots = after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if roots.isEmpty() and after.count() == after.select("a").distinct().count():
            links = after
            break
        links = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
