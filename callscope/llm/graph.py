"""Connected components by large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "k")
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest one."""
    least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    tied = edges.join(least, F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; a component is named by its least node.

    Neighbours are never gathered: each step is an aggregate of minima and a join on the node,
    whose hot keys adaptive execution splits. Each round goes to the shared scratch folder.
    The number of rounds is logarithmic in the nodes.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if new == mark or not new["n"]:
            break
        mark = new
        now = stored(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct(), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
