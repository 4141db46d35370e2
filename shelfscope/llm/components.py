"""Connected components by alternating large-star and small-star steps on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.storage import removed, stored


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours move to the smallest of them: the larger ones, or the smaller ones and itself.

    `edges` (a, b) have a > b."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("least")).withColumnRenamed("a", "b")
        return edges.join(least, "b").select("a", F.col("least").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one: then the stars are components."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter("up > 1 OR up > 0 AND down > 0").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node that it reaches.

    Each round is one large and one small star, each written to the shared folder (in one plan the first would stand
    there for every use in the second, and the driver holds every plan), until the edges are stars with the smallest
    node in the middle. A node of very many edges meets one row in each join, so adaptive execution can split it;
    minima are pre-aggregated.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not settled(edges):
        for large in (True, False):
            before, edges = edges, stored(stars(edges, large), "edges")
            removed(before)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
