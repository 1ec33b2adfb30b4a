"""Minimum spanning forests by Boruvka rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import counted, cut, drop, union


def mcst(graph: Graph) -> DataFrame:
    """src, dst (src < dst), weight of the edges of the forest of least weight.

    Directions are left aside and edges ordered by (weight, smaller end, larger end), which makes the
    forest unique. In a round every component takes its least edge; components that are joined become
    one, and of the edges between two components only the least stays.
    """
    graph.need_weights("a spanning forest")
    ends = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight")
    ends = ends.groupBy("u", "v").agg(F.min("weight").alias("weight"))
    edges, left = counted(ends.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v").alias("e")))
    taken = []
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = cut(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.e").alias("e")))
        taken.append(best.select("e").distinct())
        back = best.select(F.col("a").alias("x"), F.col("b").alias("y"))
        mutual = (F.col("y") == F.col("a")) & (F.col("a") < F.col("b"))  # of two that choose each other the smaller is the root
        up = best.join(back, best.b == back.x).select("a", F.when(mutual, F.col("a")).otherwise(F.col("b")).alias("p"))
        kept, moved = counted(up)
        up = kept
        while moved:  # to the roots
            over = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = up.join(over, "p").select("a", F.col("pp").alias("q"), (F.col("p") != F.col("pp")).alias("moved"))
            jumped = cut(jumped)
            drop(kept)
            kept = jumped
            moved, up = jumped.where("moved").limit(1).count(), jumped.select("a", F.col("q").alias("p"))
        pa, pb = (up.select(F.col("a").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        joined = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        pairs = joined.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.min("e").alias("e"))
        before = edges
        edges, left = counted(pairs)
        drop(before, kept)
    if not taken:
        return edges.select(F.col("e.u").alias("src"), F.col("e.v").alias("dst"), "e.weight")
    return union(taken).select(F.col("e.u").alias("src"), F.col("e.v").alias("dst"), "e.weight")


def mcst_summary(graph: Graph) -> DataFrame:
    """tree_edges, cc_count and total_weight."""
    n = graph.vertices.count()
    sums = mcst(graph).agg(F.count("*").alias("tree_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    return sums.select("tree_edges", (F.lit(n) - F.col("tree_edges")).alias("cc_count"), "total_weight")
