"""Random graphs. Edge i depends on the seed and i alone, so any part can be made anywhere, again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import with_mixed


#: 2^32, to turn 32 hashed bits into a number from 0 to 1.
WHOLE = float(2**32)
WEIGHTS = 3


def _finished(edges: DataFrame, seed: int, weighted: bool, symmetric: bool) -> DataFrame:
    if weighted:
        edges = with_mixed(edges, "id", {"weight": (seed, WEIGHTS)}).withColumn("weight", F.col("weight") / WHOLE)
    return _symmetric(edges.select("src", "dst", *(["weight"] if weighted else [])), symmetric)


def _symmetric(edges: DataFrame, symmetric: bool) -> DataFrame:
    if not symmetric:
        return edges
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c == "weight")))


def rmat(spark: SparkSession, scale: int = 16, n_edges: int = 1 << 20, a: float = 0.57, b: float = 0.19, c: float = 0.19, noise: float = 0.05, seed: int = 1, weighted: bool = False, symmetric: bool = False) -> DataFrame:
    """R-MAT: a quadrant is drawn for each bit of the two ids, its chances varied by up to ``noise`` a level."""
    chances = (a, b, c, 1 - a - b - c)
    names = {f"u{k}": (seed, 4 * k) for k in range(scale)}
    if noise:
        names |= {f"n{k}_{q}": (seed + 1, 4 * k + q) for k in range(scale) for q in range(4)}
    rows = with_mixed(spark.range(n_edges), "id", names)
    rows = rows.withColumns({f"u{k}": F.col(f"u{k}") / WHOLE for k in range(scale)})
    if noise:
        rows = rows.withColumns({f"n{k}_{q}": F.lit(chances[q]) * (1 - noise + 2 * noise / WHOLE * F.col(f"n{k}_{q}")) for k in range(scale) for q in range(4)})
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = F.col(f"u{k}")
        pa, pb, pc = (F.col(f"n{k}_{q}") for q in range(3)) if noise else (F.lit(x) for x in chances[:3])
        if noise:
            u = u * (pa + pb + pc + F.col(f"n{k}_3"))
        down = u >= pa + pb
        right = ((u >= pa) & (u < pa + pb)) | (u >= pa + pb + pc)
        src, dst = src * 2 + down.cast("long"), dst * 2 + right.cast("long")
    return _finished(rows.select("id", src.alias("src"), dst.alias("dst")), seed, weighted, symmetric)


def erdos_renyi(spark: SparkSession, n_vertices: int = 1 << 16, n_edges: int = 1 << 20, self_loops: bool = False, seed: int = 1, weighted: bool = False, symmetric: bool = False) -> DataFrame:
    """Both ends drawn evenly; without self-loops the target of one moves on by one."""
    rows = with_mixed(spark.range(n_edges), "id", {"src": (seed, 1), "dst": (seed, 2)})
    rows = rows.withColumns({"src": F.col("src") % n_vertices, "dst": F.col("dst") % n_vertices})
    if not self_loops:
        rows = rows.withColumn("dst", F.when(F.col("src") == F.col("dst"), (F.col("dst") + 1) % n_vertices).otherwise(F.col("dst")))
    return _finished(rows, seed, weighted, symmetric)


def bipartite(spark: SparkSession, n_left: int, n_vertices: int = 1 << 16, n_edges: int = 1 << 20, seed: int = 1, weighted: bool = False, symmetric: bool = False) -> DataFrame:
    """From the first ``n_left`` ids to the others."""
    if not 0 < n_left < n_vertices:
        raise ValueError("both sides need vertices")
    rows = with_mixed(spark.range(n_edges), "id", {"src": (seed, 1), "dst": (seed, 2)})
    return _finished(rows.withColumns({"src": F.col("src") % n_left, "dst": n_left + F.col("dst") % (n_vertices - n_left)}), seed, weighted, symmetric)
