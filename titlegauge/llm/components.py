"""Connected components of an undirected graph, as rounds of joins over its edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import written


def _toward_smallest(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each node links its neighbours (all larger ones if ``large``, else all smaller
    ones and itself) to the smallest node it knows."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    linked = both.join(smallest, "a")
    if large:
        moved = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            smallest.select("a", F.col("least").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    ``edges`` has two long columns ``a`` and ``b``. Alternating large-star and small-star steps need
    about log(n) rounds, and every step makes at most one row per edge; each round is written to
    the shared folder. The loop ends when a round changes nothing.
    """
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state["n"] == 0 or seen == (state["n"], state["sum"]):
            break
        seen = (state["n"], state["sum"])
        edges = written(_toward_smallest(_toward_smallest(edges, large=True), large=False))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
