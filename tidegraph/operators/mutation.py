"""Changing a graph: appending, marking as deleted, purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import uniform
from .pageindex import PER_PAGE, paged


def append_edges(edges: DataFrame, more: DataFrame, batch_id: int | None = None) -> DataFrame:
    """The edges of both, repeated ones included."""
    if batch_id is not None:
        edges = edges if "batch_id" in edges.columns else edges.withColumn("batch_id", F.lit(0))
        more = more.withColumn("batch_id", F.lit(batch_id))
    return edges.unionByName(more)


def delete_edges(edges: DataFrame, which: Column | DataFrame) -> DataFrame:
    """Marks edges as deleted: those that a condition holds for, or all that are named by (src, dst).

    They keep their places, so filters stay valid (they may say too much, never too little).
    """
    was = F.col("is_deleted") if "is_deleted" in edges.columns else F.lit(False)
    if isinstance(which, DataFrame):
        named = which.select("src", "dst").distinct().withColumn("_gone", F.lit(True))
        return edges.join(named, ["src", "dst"], "left").withColumn("is_deleted", was | F.col("_gone").isNotNull()).drop("_gone")
    return edges.withColumn("is_deleted", was | F.coalesce(which, F.lit(False)))


def drawn(percent: float, seed: int = 1) -> Column:
    """A condition that holds for about ``percent`` of the edges, the same ones every time."""
    return uniform(F.lit(seed), F.col("src"), F.col("dst")) < F.lit(percent / 100)


def live(edges: DataFrame) -> DataFrame:
    """The edges that are not deleted."""
    return edges.where(~F.col("is_deleted")) if "is_deleted" in edges.columns else edges


def purge(edges: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """The live edges alone, in new pages, in the order that they had."""
    kept = live(edges).drop("is_deleted")
    if "row" in kept.columns:
        return paged(kept.drop("page_id").withColumnRenamed("row", "_row"), "_row", per_page=per_page).drop("_row")
    return paged(kept, per_page=per_page)
