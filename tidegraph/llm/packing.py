"""Best-fit packing by minimum bin slack (operator 7).

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length
decides how well they pack, so the bins are planned on that histogram (at most ``capacity`` rows,
whatever the size of the corpus): per bin a bitset subset-sum over the lengths still available finds
the fullest combination that holds the longest one left, and it is taken out as often as the counts
allow. Every piece then finds its bin from its rank among the pieces of its length, by arithmetic.

Defined results: a null text is empty and makes one piece with the end id alone; a text of any length is
encoded whole, then cut; repeated rows are packed each; ties (pieces of one length) are settled by their
place in the input; a null ``doc_id`` is kept; an empty table gives an empty result; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .storage import materialise
from .tokenize import CHUNK_BYTES, REMEMBERED, chunks, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
#: One pattern of a plan: lengths with copies, and the number of bins made so.
Pattern = tuple[list[tuple[int, int]], int]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that fills ``room`` best, as (length, copies), longer ones first."""
    lengths = [x for x in sorted(counts, reverse=True) if x <= room and counts[x]]
    reach, seen, within = 1, [], (1 << room + 1) - 1
    for x in lengths:
        seen.append(reach)
        copies, step = min(counts[x], room // x), 1
        while copies:
            step = min(step, copies)
            reach |= reach << step * x & within
            copies -= step
            step *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for x, before in zip(reversed(lengths[: len(seen)]), reversed(seen)):
        copies = 0
        while not before >> total & 1:
            total -= x
            copies += 1
        if copies:
            chosen.append((x, copies))
    return chosen[::-1]


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """A plan that packs ``counts[length]`` pieces of every length into bins of ``capacity``."""
    left = {x: n for x, n in counts.items() if n}
    if any(not 1 <= x <= capacity for x in left):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan: list[Pattern] = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = dict(fullest(left, capacity - longest))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            left[x] -= n * bins
            if not left[x]:
                del left[x]
        plan.append((sorted(chosen.items(), reverse=True), bins))
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, at_once: int = CHUNK_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """Encodes whole texts, ends each with ``end_id`` and cuts those over ``capacity``; the first piece is the short one.

    ``part`` and ``rank`` number the pieces of one length within a task. ``keep_ids`` adds the ids. A worker
    holds some 30 times ``at_once`` bytes of text, and 150 bytes for each of ``remembered`` word pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, end = encoder(vocabulary, remembered), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.uint32(end_id).tobytes()
        for batch in batches:
            for a, b in chunks(batch.column(1), at_once):
                ids, at = enc.encode(batch.column(1).slice(a, b - a))
                sizes = np.diff(at) + 1
                full = (sizes - 1) // capacity
                row = np.repeat(np.arange(len(sizes)), full + 1)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
                head = sizes - full * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                rank = np.empty(len(row), np.int64)
                order = np.argsort(length, kind="stable")
                kinds, begins, many = np.unique(length[order], return_index=True, return_counts=True)
                rank[order] = np.arange(len(row)) - np.repeat(begins, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                lo = at[row] + start
                last = piece == full[row]
                hi = lo + length - last
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(lo.tolist(), hi.tolist())]
                crc = [zlib.crc32(end, c) if z else c for c, z in zip(crc, last.tolist())]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)]
                if keep_ids:
                    columns.append(pa.array([[*ids[x:y].tolist(), *[end_id] * int(z)] for x, y, z in zip(lo, hi, last)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])

    NAMES = [*(x.split()[0] for x in PIECES.split(", ")), "ids"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to materialised pieces (``length``, ``part``, ``rank``)."""
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = minimum_bin_slack(counts, capacity)
    used, runs, first_bin = dict.fromkeys(counts, 0), [], 0
    for pattern, bins in plan:
        place = 0
        for x, copies in pattern:
            runs.append((x, used[x], copies, first_bin, place))
            used[x] += copies * bins
            place += copies * x
        first_bin += bins
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    wide = max([0, *counts.values()]) + 1
    keys = table[:, 0].astype(object) * wide + table[:, 1]
    keys = keys.astype(np.int64) if (capacity + 1) * wide < 2**62 else keys

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            run = table[np.searchsorted(keys, length.astype(keys.dtype) * wide + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 2], run[:, 4] + nth % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).drop("rank")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, at_once: int = CHUNK_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(token_pieces(docs, vocabulary, capacity, end_id, keep_ids, at_once, remembered), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence (at most ``capacity`` each), from a result packed with ``keep_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
