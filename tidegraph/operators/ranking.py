"""Ranks of vertices from the ranks of those that point at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import HUB, Graph, mirrored
from ..plans.lineage import cut, drop

#: Rounds planned together before the state is written.
TOGETHER = 5


def _passed_on(edges: DataFrame, senders: DataFrame, share: Column) -> DataFrame:
    """to, got: the sums of what the senders (id, deg, parts, ..) pass on along each edge."""
    each = mirrored(senders.select(F.col("id").alias("src"), "parts", share.alias("share")))
    return edges.join(each, ["src", "part"]).groupBy(F.col("dst").alias("to")).agg(F.sum("share").alias("got"))


def pagerank(graph: Graph, rounds: int = 5, damping: float = 0.85, hub: int = HUB) -> DataFrame:
    """id, rank: from 1 each, ``rounds`` times 0.15 + 0.85 * the sum of rank / out-degree over incoming edges.

    Ranks are not normalised, and what a vertex without edges out holds is not passed on. Sources of over ``hub``
    edges are dealt over several tasks.
    """
    edges, known = graph.vertex_cut(hub)
    state, before = known.withColumn("rank", F.lit(1.0)), None
    for k in range(rounds):
        sums = _passed_on(edges, state.where("deg > 0"), F.col("rank") / F.col("deg"))
        state = known.join(sums, known.id == sums["to"], "left").select("id", "deg", "parts", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % TOGETHER == TOGETHER - 1 or k == rounds - 1:
            state = cut(state)
            if before is not None:
                drop(before)
            before = state
    edges.unpersist()
    return state.select("id", "rank")


def pagerank_delta(graph: Graph, rounds: int = 30, threshold: float = 0.5, damping: float = 0.85, hub: int = HUB) -> DataFrame:
    """id, rank, delta: only vertices whose change for each edge out is over the threshold pass it on.

    A sender adds its delta to its rank and starts anew; what is left in delta at the end is not added.
    """
    edges, known = graph.vertex_cut(hub)
    state = cut(known.select("id", "deg", "parts", F.lit(1 - damping).alias("rank"), F.lit(1.0).alias("delta")))
    sends = (F.col("deg") > 0) & (F.col("delta") / F.greatest("deg", F.lit(1)) > threshold)
    for _ in range(rounds):
        senders = state.where(sends)
        if senders.isEmpty():
            break
        got = _passed_on(edges, senders, F.col("delta") / F.col("deg"))
        left = F.when(sends, F.lit(0.0)).otherwise(F.col("delta"))
        after = state.join(got, state.id == got["to"], "left")
        before, state = state, cut(after.select("id", "deg", "parts", (F.col("rank") + F.when(sends, F.col("delta")).otherwise(F.lit(0.0))).alias("rank"), (left + damping * F.coalesce("got", F.lit(0.0))).alias("delta")))
        drop(before)
    edges.unpersist()
    return state.select("id", "rank", "delta")
