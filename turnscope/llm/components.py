"""Connected components by alternating large and small stars: edges shrink to stars around the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.join(least, "a").where("b > a and b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of them. ``a`` is the greater end."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    tied = down.join(least, "a").where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return tied.unionByName(least.select("a", F.col("root").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being the least node of its component.

    Rounds grow with the logarithm of the longest path. Each is written to the shared folder, so the lineage stays
    short and a lost executor costs a re-read. Sums of edge hashes tell when nothing changes any more.
    """
    now = materialize(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (mark := _fingerprint(now)) != before:
        before = mark
        now = materialize(_small_star(_large_star(now)).distinct(), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())
