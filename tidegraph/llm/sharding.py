"""Sharding by sampled splitters (operator 10).

Records are ordered by (key, id, row), the key being a hash of the text, so that equal texts lie together;
the row number parts even records that are alike in all else. A size-weighted sample of such places gives
the quantile boundaries of the ranges, as many as the records ask for; ranges that turn out overfull are
subdivided by places drawn within them, all in one pass. Within the ranges running sums give every record
its place among all bytes, and so its shard: shards are near equal in bytes, with exact sums, whatever the
sample missed; what is left is the size of single records at the edges of shards.

A boundary is moved to the front of its key unless another lies in the same key. So equal texts share a
range, and a shard, unless they fill a range or are more than ``TOGETHER`` of a shard.

Defined results: a null text has size 1 and the checksum of the empty text; a text of any length is one
record (shards are no more even than their longest record allows); repeated rows have a place each, and
ties between rows that are alike are settled by their place in the input; a null id is kept and comes
first; an empty table gives an empty result; extra columns, whatever their names, are ignored by ``shard``
and written by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import materialise, unused

#: Ranges for each shard, records for which there is another range, ranges at most.
RANGES, RECORDS, MOST = 16, 500_000, 1 << 16
#: Places drawn for each range, and how many times its share makes a range overfull.
DRAWN, OVERFULL = 32, 2.0
#: The part of a shard that equal texts may take to stay together.
TOGETHER = 1 / 64


def places(key: np.ndarray, doc_id: np.ndarray, has_id: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order of records as bytes that compare alike: key, id (null first), row."""
    out = np.zeros(len(key), [("key", ">u8"), ("id", ">u8"), ("null", "u1"), ("row", ">u8"), ("end", "u1")])
    sign = np.uint64(1 << 63)
    out["key"] = key.view(np.uint64) ^ sign
    out["id"] = np.where(has_id, doc_id.view(np.uint64) ^ sign, np.uint64(0))
    out["null"], out["row"], out["end"] = has_id, row.view(np.uint64), 1  # a last byte that is not zero: it would be cut off
    return out.view(f"S{out.dtype.itemsize}").reshape(-1)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    key, doc_id, row = (batch.column(batch.schema.get_field_index(x)) for x in ("key", "doc_id", "row"))
    return places(np.asarray(key), np.asarray(doc_id.fill_null(0)), np.asarray(doc_id.is_valid()), np.asarray(row))


def draw(rows: DataFrame, rate: float, cuts: np.ndarray | None = None, within: np.ndarray | None = None) -> np.ndarray:
    """Sorted places, drawn with a chance of size * ``rate``; only in the ranges ``within`` of ``cuts`` if these are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lot = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("size", "lot"))
            own = _columns(batch)
            keep = lot < size * rate
            if cuts is not None:
                keep &= np.isin(np.searchsorted(cuts, own, side="right"), within)
            yield pa.RecordBatch.from_arrays([pa.array(own[keep].tolist(), pa.binary())], names=["place"])

    lot = (F.xxhash64("key", "doc_id", "row", F.lit("draw")).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))).alias("lot")
    found = rows.select("key", "doc_id", "row", "size", lot).mapInArrow(run, "place binary").collect()  # about DRAWN for each range
    return np.sort(np.array([bytes(r.place) for r in found], "S26"))


def quantiles(drawn: np.ndarray, ranges: int) -> np.ndarray:
    """Boundaries between ``ranges`` ranges of as many drawn places each."""
    if not len(drawn) or ranges < 2:
        return drawn[:0]
    return np.unique(drawn[(len(drawn) * np.arange(1, ranges) // ranges)])


def fronts(cuts: np.ndarray) -> np.ndarray:
    """Moves each boundary that is alone in its key to the front of that key."""
    if not len(cuts):
        return cuts
    keys = cuts.astype("S8")
    alone = np.ones(len(cuts), bool)
    same = keys[1:] == keys[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return np.unique(np.where(alone, keys.astype(cuts.dtype), cuts))


def with_ranges(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Adds ``range``: how many boundaries lie at or below a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cuts, _columns(batch), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", range int")


def records(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, key and row (``row`` if it is given) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), number.alias("row"))


def boundaries(rows: DataFrame, shards: int) -> tuple[np.ndarray, int]:
    """The boundaries of the ranges of materialised records, and all bytes."""
    told = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total = told["bytes"] or 0
    ranges = min(MOST, max(shards * RANGES, -(-told["n"] // RECORDS)))
    full = max(1.0, total / ranges)
    cuts = fronts(quantiles(draw(rows, DRAWN / full), ranges))
    per = with_ranges(rows, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row for each range
    if over := {r.range: r.bytes for r in per if r.bytes > OVERFULL * full and r.n > 1}:
        more = draw(rows, DRAWN / full, cuts, np.array(sorted(over)))
        at = np.searchsorted(cuts, more, side="right")
        finer = [quantiles(more[at == k], min(MOST, int(size / full) + 1)) for k, size in over.items()]
        cuts = np.unique(np.concatenate([cuts, *finer]))
    return cuts, total


def place(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to materialised records."""
    cuts, total = boundaries(rows, shards)
    rows = materialise(with_ranges(rows, cuts), "ranges")
    parts = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    parts = parts.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    own = Window.partitionBy("range").orderBy("key", F.col("doc_id").asc_nulls_first(), "row")
    placed = rows.withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(own))
    placed = placed.join(F.broadcast(parts), "range")  # at most a few times MOST rows of 20 bytes
    same = Window.partitionBy("range", "key")
    first, weight = F.min(F.col("upto") - F.col("size")).over(same), F.sum("size").over(same)
    middle = F.col("bytes_before") + F.when(weight <= total / shards * TOGETHER, first + weight / 2).otherwise(F.col("upto") - F.col("size") / 2)
    shard = F.least(F.floor(middle * shards / F.lit(float(max(1, total)))), F.lit(shards - 1)).cast("int")
    placed = materialise(placed.withColumn("shard", shard).withColumn("nth", F.col("n_before") + F.col("nth") - 1), "placed")
    starts = placed.groupBy("shard").agg(F.min("nth").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", (F.col("nth") - F.col("start")).cast("long"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, under the law ``bytes``."""
    placed = place(materialise(records(docs), "records"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: int, folder: str) -> str:
    """Writes the documents with all their columns as a folder of Parquet for each shard. Returns the name of the folders' column.

    Rows are numbered first and written so, and their places are joined by that number: ids may repeat or be null.
    """
    row, by = unused("row", docs.columns), unused("shard", docs.columns)
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = place(materialise(records(numbered, row), "records"), shards)
    placed = placed.select(F.col("row").alias(row), F.col("shard").alias(by))
    numbered.join(placed, row).drop(row).write.partitionBy(by).parquet(folder)
    return by
