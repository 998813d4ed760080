"""Connected components of an edge list by alternating stars: every round points each node's neighbours at the least node
it sees, first the larger ones, then the smaller ones, until the edges are stars about their least nodes. Rounds number about the
square of the logarithm of the longest path. Each round's edges are written to the shared folder; nothing is gathered on the driver
but a count, and no round runs on edges that are stars already. A node with very many edges is pre-aggregated (min) and its edges are joined back on the node, a
join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u")
    return (near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that points at a lesser one points at no other, and at one that points at none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up > 0 and down > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is the least node that can be reached."""
    edges = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        edges = staged(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges (u, v) as edges between the components that ``labels`` (node, component) gives their ends; a node without a label is
    its own component."""
    for end in ("u", "v"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias("c"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return edges.select("u", "v").where("u != v")
