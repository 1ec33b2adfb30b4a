"""Triangles of symmetric graphs, exact and estimated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph

PRIME = 2**31 - 1


def triangles_exact(graph: Graph) -> DataFrame:
    """id, triangles that a vertex is in.

    Each edge points from its end of fewer neighbours to the other (ties by id), so that no vertex
    points at many; a triangle is then found once, at its corner that points at both others.
    """
    edges = graph.edges.where("src <> dst").select("src", "dst").distinct()
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    a, b = (degree.select(F.col("id").alias(x), F.struct("deg", "id").alias(f"o{x}")) for x in ("src", "dst"))
    up = edges.join(a, "src").join(b, "dst").where("osrc < odst").select("src", "dst", "odst")
    first, second = up.select("src", F.col("dst").alias("b"), F.col("odst").alias("ob")), up.select("src", F.col("dst").alias("c"), F.col("odst").alias("oc"))
    open_ = first.join(second, "src").where("ob < oc").select("src", "b", "c")
    closed = open_.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
    per = closed.select(F.explode(F.array("src", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return graph.vertices.join(per, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def min_hash(v: Column, k: int) -> Column:
    """Hash ``k`` of an id: a line modulo a prime."""
    return (F.pmod(v, F.lit(PRIME)) * F.lit((1103515245 * (k + 1)) % PRIME) + F.lit((12345 + 2246822519 * k) % PRIME)) % F.lit(PRIME)


def triangles_minhash(graph: Graph, rounds: int = 100) -> DataFrame:
    """id, estimate: from how often the least hashes of two neighbours' neighbours agree.

    An edge whose ends agree in z of ``rounds`` hashes counts z / (z + rounds) * (degrees of both) / 2
    for both of them. All rounds are one aggregation and one pair of joins.
    """
    edges = graph.edges.select("src", "dst")
    least = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"), *(F.min(min_hash(F.col("dst"), k)).alias(f"h{k}") for k in range(rounds)))
    signed = least.select("id", "deg", F.array(*(F.col(f"h{k}") for k in range(rounds))).alias("h"))
    a, b = (signed.select(F.col("id").alias(x), F.col("deg").alias(f"d{x}"), F.col("h").alias(f"h{x}")) for x in ("src", "dst"))
    z = F.aggregate(F.zip_with("hsrc", "hdst", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    both = edges.join(a, "src").join(b, "dst").select("src", z.alias("z"), (F.col("dsrc") + F.col("ddst")).alias("d"))
    per = both.groupBy(F.col("src").alias("id")).agg((F.sum(F.col("z") / (F.col("z") + rounds) * F.col("d")) / 2).alias("estimate"))
    return graph.vertices.join(per, "id", "left").select("id", F.coalesce("estimate", F.lit(0.0)).alias("estimate"))


def triangle_total(per_vertex: DataFrame, column: str) -> DataFrame:
    return per_vertex.agg((F.sum(column) / 3).alias("total"))
