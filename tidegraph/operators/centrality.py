"""Betweenness of the shortest paths from one source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut, union
from ..plans.superstep import AHEAD, SHORT
from .traversal import bfs, sssp

#: Paths whose lengths differ by less count as equal.
BAND = 1e-12


def path_edges(graph: Graph, source: int) -> DataFrame:
    """src, dst of the edges that lie on a shortest path from the source."""
    if graph.weighted:
        dist = sssp(graph, source).select("id", "distance")
        edges = graph.edges.where("src <> dst")
    else:
        dist = bfs(graph, source).select("id", F.col("level").cast("double").alias("distance"))
        edges = graph.edges.where("src <> dst").withColumn("weight", F.lit(1.0))
    a, b = (dist.select(F.col("id").alias(x), F.col("distance").alias(f"d{x}")) for x in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where(F.abs(F.col("dsrc") + F.col("weight") - F.col("ddst")) < BAND).select("src", "dst")


def _summed(dag: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, x: over all paths of a DAG that begin in ``start`` (id, x) and have an edge, the sum of x times the shares of their edges.

    A step sends what the paths of so many edges have gathered one edge further; while few vertices are
    reached, a plan goes several steps. A DAG has no path of more than ``hops`` edges.
    """
    frontier, left, found, gone = start, start.count(), [], 0
    while left:
        if gone > hops:
            raise ValueError("edges of weight 0 make a cycle")
        ahead, layers = AHEAD if left <= SHORT else 1, []
        for k in range(ahead):
            frontier = dag.join(frontier, dag.src == frontier.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))
            layers.append(frontier.withColumn("step", F.lit(k)))
        made = cut(union(layers))
        found.append(made.select("id", "x"))
        if len(found) > 12:
            found = [cut(union(found).groupBy("id").agg(F.sum("x").alias("x")))]
        frontier, gone = made.where(F.col("step") == ahead - 1).select("id", "x"), gone + ahead
        left = frontier.count()
    return union(found).groupBy("id").agg(F.sum("x").alias("x")) if found else start.where("false")


def betweenness(graph: Graph, source: int = 0) -> DataFrame:
    """id, paths (shortest ones from the source) and centrality (their share through a vertex, summed over the others)."""
    dag = cut(path_edges(graph, source).groupBy("src", "dst").agg(F.count("*").cast("double").alias("share")))
    hops = dag.select("dst").distinct().count()
    root = graph.vertices.where(F.col("id") == source).select("id", F.lit(1.0).alias("x"))
    paths = cut(root.unionByName(_summed(dag, root, hops)))
    sigma = lambda end, name: paths.select(F.col("id").alias(end), F.col("x").alias(name))
    back = dag.join(sigma("src", "own"), "src").join(sigma("dst", "theirs"), "dst")
    back = cut(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") * F.col("own") / F.col("theirs")).alias("share")))
    through = _summed(back, paths.select("id", F.lit(1.0).alias("x")), hops).withColumnRenamed("x", "centrality")
    return paths.join(through, "id", "left").select("id", F.col("x").alias("paths"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def max_centrality(per_vertex: DataFrame, source: int) -> DataFrame:
    """The vertex of most centrality, the source left out (the least id on ties)."""
    top = F.max(F.struct("centrality", (-F.col("id")).alias("n")))
    return per_vertex.where(F.col("id") != source).agg(top.alias("t")).select((-F.col("t.n")).alias("id"), F.col("t.centrality").alias("centrality"))
