"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.plans.lineage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a centre or the leaf of one centre."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(1)))
    mixed = ends.groupBy("id").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least")).where("leaves > 1 or (leaves = 1 and least = 0)")
    return mixed.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for the ids of links ``(a, b)``; the component is its smallest id.

    Works in rounds over shared-folder tables until every component is a star; self-links and repeated links are fine,
    a hub is aggregated before the shuffle and joined with its one minimum.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        after = materialize(_small_star(_large_star(edges)), "links")
        discard(edges)
        edges = after
        if _settled(edges):
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
