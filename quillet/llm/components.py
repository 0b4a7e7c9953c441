"""Connected components by alternating large-star and small-star steps, all as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a < b; every b is joined to its least neighbour, as are its other smaller ones."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
    joined = edges.join(least, F.col("b") == F.col("n"))
    moved = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: comparable, not null); root is the least node reachable.

    Each round is written to the shared folder, so lineage stays short; nothing but two counts reaches the
    driver. The edges end as stars around the roots. Self-loops and repeated edges are allowed; no edges give
    no rows. A node with very many neighbours only meets minima (partial aggregates) and joins that AQE splits.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    was = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == was:
            break
        was = seen
        after = materialize(_small_star(_large_star(now)))
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
