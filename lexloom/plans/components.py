"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges and labels stay distributed: a round is two aggregations, combined before their shuffle, and two joins, written to the
shared folder; only an edge count and checksum reach the driver to see whether a round changed anything. The centre of a
star may hold most edges: joins on it broadcast the centres that are hot by their degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans.joins import join_counted
from lexloom.plans.staging import staged, unstage


def _large_star(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """Every greater neighbour of a node moves to the node's least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    least = staged(least.filter("n > 0"), "stars")
    return join_counted(both.filter("v > u"), least, "u", "n", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), least


def _small_star(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """A node and its lesser neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = staged(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
    moved = join_counted(down, least, "u", "n", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (comparable ids, u != v, not null). Returns node, root (the least node reachable) for every node of an edge."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if got == mark or got[0] == 0:
            break
        mark = got
        large, centres = _large_star(now, got[0])
        large = staged(large, "edges")
        small, leaves = _small_star(large, got[0])  # moving edges adds none
        after = staged(small, "edges")
        unstage(now, large, centres, leaves)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
