"""The independent set that takes ids in ascending order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import counted, cut, drop


def mis(graph: Graph) -> DataFrame:
    """id, in_mis: a vertex is in unless a smaller one with an edge to it is.

    Each round settles the vertices that no smaller undecided one points at; those that they point at are
    out. Only edges between undecided vertices stay, so a round's work shrinks with them.
    """
    edges, left = counted(graph.edges.where("src < dst").select("src", "dst").distinct())
    outs = []
    while left:
        free = edges.select(F.col("src").alias("id")).join(edges.select(F.col("dst").alias("id")), "id", "left_anti").distinct()
        free = cut(free)
        out = cut(edges.join(free, edges.src == free.id, "left_semi").select(F.col("dst").alias("id")).distinct())
        outs.append(out)
        gone = free.unionByName(out)
        src, dst = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
        before = edges
        edges, left = counted(edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select("src", "dst"))
        drop(before, free)
    vertices = graph.vertices
    if not outs:
        return vertices.select("id", F.lit(True).alias("in_mis"))
    excluded = outs[0]
    for more in outs[1:]:
        excluded = excluded.unionByName(more)
    return vertices.join(excluded.withColumn("out", F.lit(True)), "id", "left").select("id", F.col("out").isNull().alias("in_mis"))
