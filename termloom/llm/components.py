"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is two groupings of the edges, so no vertex gathers its neighbours in a
list: the least neighbour is an aggregate that is combined before the shuffle. Every
round is written to the shared folder, which cuts the lineage; the round before is
then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) of longs touches; root is the least node of its component."""
    edges = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct()
    edges, path = common.materialize(edges, "components")
    for _ in range(MAX_ROUNDS):
        star, new_path = common.materialize(_small_star(_large_star(edges)), "components")
        before, after = (
            df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")), F.lit(0))).first() for df in (edges, star)
        )
        common.drop_path(edges.sparkSession, path)
        edges, path = star, new_path
        if tuple(before) == tuple(after):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the node's least neighbour (itself included)."""
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v > m").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, with the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    linked = edges.join(least, "high").select(F.col("m"), F.explode(F.array("low", "high")).alias("v"))
    return linked.filter("m < v").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
