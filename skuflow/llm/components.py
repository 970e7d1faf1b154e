"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.tables import checkpointed


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: larger neighbours move to the smallest neighbour; then small star: smaller ones do."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
    least = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u")
    small = large.join(least, F.col("x") == F.col("u"))
    moved = small.where("y != m").select(F.col("y").alias("a"), F.col("m").alias("b"))
    return moved.union(small.select(F.col("x").alias("a"), F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge; the root is the smallest node that can be reached.

    ``edges`` has two columns of one type, one row per link, in any order. Every round is written to the shared
    folder; the loop ends when a round changes nothing, so there is no limit on rounds.
    """
    a, b = edges.columns
    edges = checkpointed(edges.where(f"`{a}` != `{b}`").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        edges = checkpointed(_stars(edges))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(found.select("root", "root")).distinct()
