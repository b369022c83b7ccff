"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.llm.store import is_empty, keep


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _is_star(edges: DataFrame) -> bool:
    """Whether each u has one v only, and no v is a u: then all components are stars round their smallest node."""
    many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    both = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return is_empty(many.unionByName(both))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (u, v): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each links the neighbours of a
    node to the smallest of them, until every component is one star (paths of n
    nodes take about log2(n) rounds). A hub's neighbours are never gathered: its
    minimum is an aggregate, written so that the join back to its edges is one that
    adaptive execution can split. Self-loops, repeated edges and null ends add
    nothing; a table without edges gives none.
    """
    star = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if is_empty(star):
        return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while not _is_star(star):
        around = _both_ways(star)
        least = keep(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").distinct(), "large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        below = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = below.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        star = keep(small, "small")
    found = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
