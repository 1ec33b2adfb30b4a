"""Block-asynchronous fixpoints: a block of edges runs to its own fixpoint, and only values of its border are exchanged.

Blocks are ranges of source ids with about equal numbers of edges, kept as compressed rows (sources, where the
edges of each begin, targets, weights). A round hands the blocks that got values their messages, relaxes
each of them in one task until nothing changes in it, and sends on the values of changed vertices along the
edges that leave it. A superstep of the synchronous runner is a step within a block here; what is left of the
exchanges is as many as a value crosses borders.

A source with more than a ``1 / PARTS`` of a block's edges is dealt over several blocks by its targets: each
holds a mirror of it, and what is sent to it goes to all of them. So no block has more than ``size`` edges,
whatever the degrees. Values must only ever fall and an edge must not make them less (``cost`` 0 or more).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, functions as F

from ..graph import Graph
from .lineage import cut, drop, union

#: Edges of a block at most (24 bytes each), and the part of a block from which on a source is a hub.
SIZE, PARTS = 1 << 18, 8
#: Rounds whose states are kept side by side before they become one table.
LOG = 8


@dataclass(frozen=True)
class BlockProgram:
    """``start``: id, v (of type ``kind``) and tag of the vertices that begin. ``along``: the values that sources of value v send over edges of weight w (numpy arrays).

    The least value wins, of equal ones the one with the least tag; the tag of what an edge sends is its source.
    """

    start: DataFrame
    along: Callable[[np.ndarray, np.ndarray], np.ndarray]
    kind: str = "double"


@dataclass(frozen=True)
class BlockResult:
    """state: id, v, tag of what was reached; rounds: exchanges; steps: those that a block took within each round at most, summed; blocks, and edges of the largest."""

    state: DataFrame
    rounds: int
    steps: int
    blocks: int
    largest: int


class Layout:
    """Which blocks hold the edges of a source: ranges of ids, and several blocks for a hub."""

    def __init__(self, bounds: np.ndarray, hubs: np.ndarray, parts: np.ndarray):
        self.bounds, self.hubs, self.parts, self.n = bounds, hubs, parts, len(bounds) + 1
        self.first = self.n + np.concatenate([[0], np.cumsum(parts)])  # hubs' blocks come after the ranges

    @property
    def blocks(self) -> int:
        return int(self.first[-1])

    def _hub(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id among the hubs, -1 for others."""
        if not len(self.hubs):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.hubs, ids), len(self.hubs) - 1)
        return np.where(self.hubs[at] == ids, at, -1)

    def of_edges(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        block, hub = np.searchsorted(self.bounds, src, "right"), self._hub(src)
        at = np.flatnonzero(hub >= 0)
        mixed = (dst[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        block[at] = self.first[hub[at]] + mixed % self.parts[hub[at]]
        return block

    def of_values(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``ids``, block): a hub has several."""
        block, hub = np.searchsorted(self.bounds, ids, "right"), self._hub(ids)
        at, held = np.flatnonzero(hub < 0), np.flatnonzero(hub >= 0)
        many = self.parts[hub[held]]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.concatenate([at, np.repeat(held, many)]), np.concatenate([block[at], np.repeat(self.first[hub[held]], many) + inner])


def layout(edges: DataFrame, size: int, least_blocks: int) -> Layout:
    """Ranges with at most about ``size`` / 2 edges each. What comes to the driver are bounds and hubs, some for each block."""
    degrees = cut(edges.groupBy("src").agg(F.count("*").alias("n")), "degrees")
    hub = max(1, size // PARTS)
    hubs = degrees.where(F.col("n") > hub).select("src", "n").orderBy("src").collect()  # at most edges / hub rows
    rest = degrees.where(F.col("n") <= hub)
    total = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = max(least_blocks, -(-2 * total // size))
    # a run of sources in the order of their ids, cut wherever another share of the edges is full
    share = max(1, -(-total // wanted))
    ranged = rest.repartitionByRange("src").sortWithinPartitions("src")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, any_ = 0, [], False
        for batch in batches:
            for src, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not any_ or held + n > share:  # every range partition starts a block of its own
                    found.append(src)
                    held, any_ = 0, True
                held += n
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["src"])

    starts = sorted(r.src for r in ranged.mapInArrow(bounds, "src long").collect())
    drop(degrees)
    return Layout(np.array(starts[1:], np.int64), np.array([r.src for r in hubs], np.int64), np.array([-(-2 * r.n // size) + 1 for r in hubs], np.int64))


BLOCK_SQL = "block long, n long, ids binary, ptr binary, dst binary, local binary, live binary, weight binary"


def stored(graph: Graph, size: int = SIZE, least_blocks: int = 1) -> tuple[DataFrame, Layout]:
    """The blocks, a row each, and how they are laid out."""
    held = cut(graph.edges.select("src", "dst", *(["weight"] if graph.weighted else [])), "edges")  # read three times, made once
    edges = held.select("src", "dst", (F.col("weight") if graph.weighted else F.lit(1.0)).alias("weight"))
    plan = layout(edges, size, least_blocks)
    if graph.symmetric:  # every target sends on
        marked = edges.withColumn("live", F.lit(True))
    else:
        live = edges.select(F.col("src").alias("s")).distinct().withColumn("live", F.lit(True))  # targets that send on
        marked = edges.join(live, F.col("dst") == F.col("s"), "left").select("src", "dst", "weight", F.col("live").isNotNull().alias("live"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plan.of_edges(batch.column(0).to_numpy(), batch.column(1).to_numpy()), pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            src, dst, weight, live = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(1, 5))
            ids, starts = np.unique(src, return_index=True)
            at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
            local = np.where(ids[at] == dst, at, -1).astype(np.int32)
            held = [ids, np.append(starts, len(src)).astype(np.int64), dst, local, live.astype(np.uint8), weight]
            return pa.RecordBatch.from_arrays([pa.array([parts[0].column(0)[0].as_py()], pa.int64()), pa.array([len(src)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=[c.split()[0] for c in BLOCK_SQL.split(", ")])

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a < b:
                    if parts and parts[0].column(0)[0].as_py() != block[a]:
                        yield row(parts)
                        parts = []
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield row(parts)

    rows = marked.mapInArrow(dealt, "block long, src long, dst long, weight double, live boolean")
    rows = rows.repartition("block").sortWithinPartitions("block", "src", "dst")
    out = cut(rows.mapInArrow(packed, BLOCK_SQL), "blocks")
    drop(held)
    return out, plan


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + counts[i] - 1 one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _better(v: np.ndarray, tag: np.ndarray, at: np.ndarray, new: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Takes what is less, in place; returns the places whose value fell."""
    fit = new <= v[at]
    at, new, by = at[fit], new[fit], by[fit]
    before = v[at]
    np.minimum.at(v, at, new)
    fell = np.unique(at[v[at] < before])
    tag[fell] = np.iinfo(np.int64).max  # tags of what was worse do not count
    tied = new == v[at]
    np.minimum.at(tag, at[tied], by[tied])
    return fell


def relax(along: Callable, ids, ptr, dst, local, weight, v, tag, got_ids, got_v, got_tag) -> tuple[np.ndarray, int]:
    """Runs a block to its fixpoint, in place; the places of changed sources, and the steps that it took."""
    at = np.searchsorted(ids, got_ids)
    known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == got_ids)
    front, steps = _better(v, tag, at[known], got_v[known], got_tag[known]), 0
    changed = np.zeros(len(ids), bool)
    while len(front):
        changed[front] = True
        counts = ptr[front + 1] - ptr[front]
        edge, source = _spread(counts, ptr[front]), np.repeat(front, counts)
        inner = local[edge] >= 0
        edge, source = edge[inner], source[inner]
        front = _better(v, tag, local[edge], along(v[source], weight[edge]), ids[source])
        steps += 1
    return np.flatnonzero(changed), steps


def run_blocks(graph: Graph, program: BlockProgram, size: int = SIZE, least_blocks: int = 1, max_rounds: int = 10_000) -> BlockResult:
    """Runs to the fixpoint by blocks of at most ``size`` edges."""
    blocks, plan = stored(graph, size, least_blocks)
    largest = blocks.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if largest > size:
        raise ValueError(f"a block of {largest} edges is over {size}: raise the number of blocks")
    tasks = max(1, min(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), 2 * plan.blocks))  # of a round: hardly two blocks each, few without one
    kept = blocks.repartition(tasks, "block").persist(StorageLevel.MEMORY_AND_DISK)
    along, kind, number = program.along, program.kind, np.dtype("float64" if program.kind == "double" else "int64")
    worst = np.inf if program.kind == "double" else np.iinfo(np.int64).max
    value = f"struct<id: bigint, v: {kind}, tag: bigint>"
    out_sql = f"state boolean, block long, id long, v {kind}, tag long, vs binary, tags binary, steps int"
    arrow_kind = pa.float64() if program.kind == "double" else pa.int64()

    def rows(state: bool, block, ids, v, tag, vs=None, tags=None, steps=0) -> pa.RecordBatch:
        n = len(block)
        held = [pa.nulls(n, pa.binary()) if x is None else pa.array([x] * n, pa.binary()) for x in (vs, tags)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, state)), pa.array(block, pa.int64()), pa.array(ids, pa.int64()), pa.array(v, arrow_kind), pa.array(tag, pa.int64()), *held, pa.array(np.full(n, steps, np.int32))], names=[c.split()[0] for c in out_sql.split(", ")])

    def routed(ids: np.ndarray, v: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        at, block = plan.of_values(ids)
        return rows(False, block, ids[at], v[at], tag[at])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield routed(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                array = lambda c, t: np.frombuffer(held[c].as_buffer(), t)
                ids, ptr, dst, local, live, weight = array("ids", np.int64), array("ptr", np.int64), array("dst", np.int64), array("local", np.int32), array("live", np.uint8), array("weight", np.float64)
                if held["vs"].is_valid:
                    v, tag = array("vs", number).copy(), array("tags", np.int64).copy()
                else:
                    v, tag = np.full(len(ids), worst, number), np.full(len(ids), np.iinfo(np.int64).max)
                got = held["got"].values
                got = [got.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
                changed, steps = relax(along, ids, ptr, dst, local, weight, v, tag, *got)
                yield rows(True, [held["block"].as_py()], [None], [None], [None], v.tobytes(), tag.tobytes(), steps)
                counts = ptr[changed + 1] - ptr[changed]
                edge, source = _spread(counts, ptr[changed]), np.repeat(changed, counts)
                out = local[edge] < 0
                edge, source = edge[out], source[out]
                to, new, by = dst[edge], along(v[source], weight[edge]), ids[source]
                order = np.lexsort((by, new, to))  # the least for each target
                order = order[np.concatenate([[True], to[order][1:] != to[order][:-1]])[: len(order)]]
                to, new, by, on = to[order], new[order], by[order], live[edge[order]] > 0
                if on.any():
                    yield routed(to[on], new[on], by[on])
                if not on.all():  # these send nothing on: they only count in the end
                    yield rows(False, np.full(int((~on).sum()), -1), to[~on], new[~on], by[~on])

    started = program.start.select("id", F.col("v").cast(kind).alias("v"), F.col("tag").cast("long").alias("tag"))
    def written(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
        """The rows as a table, how many of them are messages to blocks, and the most steps of a block."""
        told = Observation()
        out = cut(df.observe(told, F.count(F.when(~F.col("state") & (F.col("block") >= 0), 1)).alias("n"), F.max("steps").alias("steps")), label)
        return out, told.get["n"], told.get["steps"] or 0

    sent, n, _ = written(started.mapInArrow(first, out_sql), "started")
    seen, states, made, rounds, steps = [], [], [sent], 0, 0
    while n and rounds < max_rounds:
        messages = sent.where("not state and block >= 0").select("block", "id", F.struct("v", "tag").alias("x"))
        best = messages.repartition(tasks, "block").groupBy("block", "id").agg(F.min("x").alias("x"))  # dealt once, by block
        got = best.groupBy("block").agg(F.collect_list(F.struct("id", "x.v", "x.tag")).cast(f"array<{value}>").alias("got"))
        state = union(states).repartition(tasks, "block").groupBy("block").agg(F.max_by(F.struct("vs", "tags"), "round").alias("s")).select("block", "s.vs", "s.tags") if states else None
        read = kept.join(got, "block")
        read = read.join(state, "block", "left") if state is not None else read.withColumns({"vs": F.lit(None).cast("binary"), "tags": F.lit(None).cast("binary")})
        sent, n, most = written(read.mapInArrow(step, out_sql), "round")
        rounds, steps = rounds + 1, steps + most
        made.append(sent)
        states.append(sent.where("state").select("block", "vs", "tags", F.lit(rounds).alias("round")))
        seen.append(sent.where("not state and block < 0").select("id", "v", "tag"))
        if len(states) >= LOG:  # what newer rounds have replaced goes
            whole = cut(union(states).groupBy("block").agg(F.max_by(F.struct("vs", "tags"), "round").alias("s"), F.max("round").alias("round")).select("block", "s.vs", "s.tags", "round"), "states")
            ends = cut(union(seen).groupBy("id").agg(F.min(F.struct("v", "tag")).alias("x")).select("id", "x.v", "x.tag"), "ends")
            drop(*made[:-1])
            made, states, seen = [whole, ends, sent], [whole], [ends]
    out = [f.select("id", F.struct("v", "tag").alias("x")) for f in (started, *seen)]
    if states:
        last = union(states).groupBy("block").agg(F.max_by(F.struct("vs", "tags"), "round").alias("s")).select("block", "s.vs", "s.tags")

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    ids, v, tag = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((0, np.int64), (1, number), (2, np.int64)))
                    at = np.flatnonzero(v < worst)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(v[at], arrow_kind), pa.array(tag[at], pa.int64())], names=["id", "v", "tag"])

        ended = kept.select("block", "ids").join(last, "block").select("ids", "vs", "tags").mapInArrow(unpacked, f"id long, v {kind}, tag long")
        out.append(ended.select("id", F.struct("v", "tag").alias("x")))
    state = cut(union(out).groupBy("id").agg(F.min("x").alias("x")).select("id", "x.v", "x.tag"), "fixpoint")
    kept.unpersist()
    drop(blocks, *made)
    return BlockResult(state, rounds, steps, plan.blocks, largest)
