"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; the root is the
    smallest node of its component.

    Both steps keep the number of edges in bounds and take a number of rounds
    that grows with the logarithm of the nodes.  Each round is written to the
    shared folder, so lineage stays short.  A hub's edges meet its minimum, a
    partial aggregate, in a join whose large side can be split.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"),
                                                F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = (edges.join(least, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Done when all edges lead to roots: no node has two edges up, or one up and one down.
        ends = edges.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        unsettled = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")) \
            .where("up > 1 or (up = 1 and down = 1)")
        if unsettled.isEmpty():
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root")))
    raise RuntimeError("connected components did not settle")
