"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch


def with_least(rows: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """``rows`` with the column ``m`` of ``least(node, m)``.

    Joined on ``node - 1``: the aggregate is partitioned by the node itself,
    so the join shuffles both sides and AQE can split a node of many links.
    """
    right = least.select((F.col(node) - 1).alias("_n"), "m")
    return rows.withColumn("_n", F.col(node) - 1).join(right, "_n").drop("_n")


def large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (with_least(both.where("v > u"), "u", least).where("v <> m")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them (edges come with a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = with_least(edges, "a", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node points at one smaller node at most and no node that is pointed at points on."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    node = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return node.where("ups > 1 or (ups = 1 and low = 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``links(a, b)``: the smallest node it reaches.

    Each step is an aggregate with map-side combining and a join whose hot
    nodes AQE splits; steps repeat until the edges are a forest of stars.
    Self links are ignored; no links give no rows.
    """
    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "star-edges")

    n = edges.count()
    while not _is_star_forest(edges):
        edges = scratch(small_star(scratch(large_star(edges), "star-large", 2 * n)), "star-small", 2 * n)
    top = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return top.union(edges.select("b", "b").distinct())
