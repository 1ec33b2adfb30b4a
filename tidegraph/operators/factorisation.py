"""Alternating least squares on the ratings of a bipartite graph.

A half-round gives one side the factors that fit its ratings best, the other side's being fixed: the
normal equations of a vertex are sums over its ratings, (f f' and f * rating), which an aggregation adds up
with map-side combine, and Arrow batches solve them, many at a time. Lower ids are the left side; the right
side is solved first. The penalty is scaled by the number of ratings of a vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut, drop

#: The first factors of an id: hashed numbers between 0.5 and 1.
STEPS = (7919, 104729)


def first_factors(id: Column, rank: int) -> list[Column]:
    return [F.lit(0.5) + ((id + 1) * (k * STEPS[0] + 1) % STEPS[1]) / F.lit(2.0 * STEPS[1]) for k in range(rank)]


def _solved(ratings: DataFrame, side: str, other: str, factors: DataFrame, rank: int, penalty: float) -> DataFrame:
    """id and f0 .. of the vertices of a side, from the other side's."""
    held = ratings.join(factors.withColumnRenamed("id", other), other)
    pairs = [(i, j) for i in range(rank) for j in range(i + 1)]
    sums = held.groupBy(F.col(side).alias("id")).agg(
        F.count("*").alias("n"), *(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"f{i}") * F.col("rating")).alias(f"b{i}") for i in range(rank))
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, *rest = (np.asarray(c, float) for c in batch.columns[1:])
            a = np.zeros((len(n), rank, rank))
            for (i, j), x in zip(pairs, rest):
                a[:, i, j] = a[:, j, i] = x
            a += (penalty * n)[:, None, None] * np.eye(rank)
            f = np.linalg.solve(a, np.stack(rest[len(pairs) :], axis=1)[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(rank))], names=["id", *(f"f{k}" for k in range(rank))])

    return sums.mapInArrow(solve, "id long, " + ", ".join(f"f{k} double" for k in range(rank)))


def als(graph: Graph, rank: int = 5, rounds: int = 5, penalty: float = 0.065) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors (id, f0 ..) of the left and of the right side, and edges, sse and rmse over the ratings."""
    graph.need_weights("als")
    if rank < 1 or rounds < 1 or penalty <= 0:
        raise ValueError("rank and rounds must be 1 or more and the penalty over 0")
    ratings = graph.edges.where("src < dst").select(F.col("src").alias("left"), F.col("dst").alias("right"), F.col("weight").alias("rating")).persist(StorageLevel.MEMORY_AND_DISK)
    left = ratings.select(F.col("left").alias("id")).distinct()
    left = cut(left.select("id", *(x.alias(f"f{k}") for k, x in enumerate(first_factors(F.col("id"), rank)))), "factors")
    right = None
    for _ in range(rounds):
        new = cut(_solved(ratings, "right", "left", left, rank, penalty), "factors")
        drop(*filter(None, [right]))
        right = new
        new = cut(_solved(ratings, "left", "right", right, rank, penalty), "factors")
        drop(left)
        left = new
    a, b = (x.select(F.col("id").alias(s), *(F.col(f"f{k}").alias(f"{s[0]}{k}") for k in range(rank))) for x, s in ((left, "left"), (right, "right")))
    told = sum((F.col(f"l{k}") * F.col(f"r{k}") for k in range(1, rank)), F.col("l0") * F.col("r0"))
    fit = cut(ratings.join(a, "left").join(b, "right").agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.pow(F.col("rating") - told, 2)), F.lit(0.0)).alias("sse")), "fit")
    ratings.unpersist()
    return left, right, fit.select("edges", "sse", F.sqrt(F.col("sse") / F.greatest("edges", F.lit(1))).alias("rmse"))


def als_async(graph: Graph, rank: int = 5, rounds: int = 5, penalty: float = 0.065) -> DataFrame:
    """id and factors of all vertices after ``1 + 2 * rounds`` half-rounds, of which the first only counts ratings.

    An asynchronous run solves a vertex as soon as all its ratings have come in, and no vertex reads a
    neighbour of the round before: so its outcome is that of alternating sides, whatever the timing.
    """
    left, right, _ = als(graph, rank, rounds, penalty)
    return left.unionByName(right)
