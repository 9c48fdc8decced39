"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbspark.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour above its centre (large), or at or below it, to the least one around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return (
        moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one centre, and no centre on another node."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return several and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component: every node of edges (a, b) and the least node that it is connected with.

    Each round is written to the shared folder. Only whether it was the last one reaches the driver.
    """
    current = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    while not _are_stars(current):
        # a > b in both forms.
        current = staged(_star(_star(current, True), False), name)
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
