"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) joined back to the edges, so a node with very many
neighbours is never gathered in one task; each step's table is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import session


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.  Nodes without an edge are absent.

    Defined results: null ends and loops are ignored, repeated edges count once, an empty table gives no rows.
    """
    most = edges.count()
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    step = 0
    while True:
        # Large star: every larger neighbour of a node is joined to the smallest node of its neighbourhood.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = session.joined_back(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the node and its smaller neighbours are joined to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # The row of the smallest neighbour is the node's own edge, so that nothing is read once more for it.
        small = session.joined_back(large, low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # A step makes at most one edge of each edge and one of each node.
        after = session.written(small.distinct(), "edges", 2 * most)
        if step:
            session.forget(edges)
        edges, step = after, step + 1
        if _all_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour, and those that have one are nobody's smaller neighbour."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").limit(1).count() == 0
