"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored, tidy

PART_ROWS = 100_000


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one: a forest of stars."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); ``root`` is the least node of its component.

    Alternating large-star and small-star steps with a reliable checkpoint each round;
    minima are pre-aggregated, so a node with very many neighbours is no bottleneck.
    The number of edges never grows, so few edges stay in few partitions.
    """
    found = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = 1 + found.count() // PART_ROWS
    found = found.coalesce(parts)
    for _ in range(most_rounds):
        if _is_settled(found):
            break
        both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        found = stored(small.where("a <> b").distinct().coalesce(parts))
    tidy(edges.sparkSession)
    roots = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def absorb(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` (node, root) with more edges: only the graph between its roots is solved anew."""
    side = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    up = stored(components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))))
    moved = known.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(moved.union(up.join(known, "node", "left_anti").select("node", "root")))
