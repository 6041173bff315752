"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node's smallest neighbour is found by a partial aggregation, then joined back to its edges."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    nearest = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = both.join(nearest, both["a"] == nearest["node"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(nearest.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node that can be reached.

    Edges are kept with a > b. Both rounds keep components and their smallest nodes; they repeat until the edges stay the
    same, when each node points to its component's smallest. Every round is a written table; no link reaches the driver.
    Loops and nulls are ignored.
    """
    current = Written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while True:
        state = tuple(current.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return current.df.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        following = Written(_star(_star(current.df, large=True), large=False), "edges")
        current.drop()
        current = following
