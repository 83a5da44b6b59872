"""Distributed connected components by alternating star contraction.

Every step is an aggregate (smallest neighbour per node, combined map-side)
and an equi-join of the edges with it, so a node of any degree is split by
the skew join and nothing is collected. Each round's edges are written to the
shared folder; only one number reaches the driver, whether they are stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> u with the smaller of itself and its smallest neighbour."""
    return edges.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node u to the smaller v."""
    lo = _least(edges)
    down = edges.join(lo, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(lo.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Does every node point to one node at most, and no node that is pointed to
    point on? Then the targets are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out + into > 1").isEmpty()


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Undirected edges (a long, b long) -> (node, component) for every node with
    an edge; ``component`` is the smallest node reached. Self-loops, repeated
    edges and an empty table are allowed."""
    current = scratch.write(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _are_stars(current):
        after = scratch.write(_small_star(_large_star(current)).where("u != v").distinct())
        scratch.drop(current)
        current = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
