"""Connected components of a graph given as edges, entirely as joins and aggregations.

Alternating large-star and small-star rounds: each links neighbours to the
smallest node they know, and ends with every node linked to the smallest of its
component. A hub is a key of a join whose other side has one row per node, so
AQE can split it; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopledger.llm.common import stored


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _smallest_neighbour(both).select("a", F.least("a", "low").alias("low"))
    linked = both.join(low, "a").where(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _smallest_neighbour(down)
    moved = down.join(low, "a").where(F.col("b") != F.col("low"))
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
        low.select("a", F.col("low").alias("b"))
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node on an edge.

    ``edges`` has two columns of nodes; loops, nulls, repeats and both directions are
    allowed. Nodes without an edge to another node do not appear.
    """
    first, second = edges.columns
    now = stored(
        edges.select(F.col(first).alias("a"), F.col(second).alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()
    )
