"""Connected components of an undirected graph given as edges, by alternating large-star and small-star rounds.

Each round is a grouping and a join on the node, so that no component ever meets in one task; stars of hot nodes are
handled by joins that adaptive execution may split. The number of rounds grows with the logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweetframe.llm._common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the others and itself) to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct edges (u > v) has one v, which is no u itself; no further round then changes them."""
    ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)").count() == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; component: the least node that it reaches. edges: u, v of one type."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _only_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = cut(_star(_star(now, large=True), large=False))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
