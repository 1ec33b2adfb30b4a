"""Analyses that read every edge once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut
from .traversal import bfs_forest


def degree_cnt(graph: Graph) -> DataFrame:
    """id, degree: edges that leave each vertex."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_hist(graph: Graph) -> DataFrame:
    """degree, n_vertices."""
    return degree_cnt(graph).groupBy("degree").agg(F.count("*").alias("n_vertices"))


def conductance(graph: Graph) -> DataFrame:
    """Edges between odd and even ids over the larger of the edges that leave either side."""
    red, crosses = F.col("src") % 2 != 0, F.col("src") % 2 != F.col("dst") % 2
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = graph.edges.agg(count(crosses).alias("crossing"), count(red).alias("from_red"), count(~red).alias("from_black"))
    most = F.greatest("from_red", "from_black")
    return sums.withColumn("conductance", F.when(most > 0, F.col("crossing") / most))


def range_check(graph: Graph, max_id: int) -> DataFrame:
    """Edges with an end beyond ``max_id`` or below 0."""
    return graph.edges.where((F.greatest("src", "dst") > max_id) | (F.least("src", "dst") < 0))


def reverse(graph: Graph) -> DataFrame:
    return graph.reverse().edges


def spmv(graph: Graph, x: DataFrame | None = None) -> DataFrame:
    """id, y with y = x A, an edge being the element (src, dst). Without ``x`` (id, x), x[i] = i."""
    graph.need_weights("spmv")
    if x is None:
        products = graph.edges.select(F.col("dst").alias("id"), (F.col("weight") * F.col("src")).alias("p"))
    else:
        products = graph.edges.join(x.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("weight") * F.col("x")).alias("p"))
    sums = products.groupBy("id").agg(F.sum("p").alias("y"))
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("y"))


def sides(graph: Graph) -> DataFrame:
    """id and whether it has a neighbour above, below, and an edge to itself."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.max(F.col("other") > F.col("id")).alias("above"), F.max(F.col("other") < F.col("id")).alias("below"), F.max(F.col("other") == F.col("id")).alias("own"))


def checkbip(graph: Graph) -> DataFrame:
    """not_bipartite: some vertex has neighbours on both sides of its id, or itself (lower ids are the left side)."""
    bad = F.coalesce(F.max((F.col("above") & F.col("below")) | F.col("own")), F.lit(False))
    return sides(graph).agg(bad.alias("not_bipartite"), F.coalesce(F.sum(F.when((F.col("above") & F.col("below")) | F.col("own"), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_conflicts"))


def two_colours(graph: Graph) -> DataFrame:
    """id, component (its least id), colour (0 as the least id, else 1; null where there is none), bipartite, and the least edge of an odd cycle of the component.

    Edges count both ways. Colours are the parities of the levels below each least id; an edge between two vertices of
    the same parity closes an odd cycle with their ways down the tree, and a component without one has two colours.
    """
    both = graph.unweighted().symmetrize()
    levels = cut(bfs_forest(both).select("id", "component", (F.col("level") % 2).alias("side")), "levels")
    a = levels.select(F.col("id").alias("src"), F.col("component").alias("c"), F.col("side").alias("sa"))
    b = levels.select(F.col("id").alias("dst"), F.col("side").alias("sb"))
    odd = both.edges.join(a, "src").join(b, "dst").where("sa = sb").groupBy("c").agg(F.min(F.struct("src", "dst")).alias("odd"))
    held = levels.join(odd, F.col("component") == F.col("c"), "left")
    even = F.col("odd").isNull()
    return held.select("id", "component", F.when(even, F.col("side")).alias("colour"), even.alias("bipartite"), F.col("odd.src").alias("odd_src"), F.col("odd.dst").alias("odd_dst"))
