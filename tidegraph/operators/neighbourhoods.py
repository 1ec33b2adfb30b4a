"""Sizes of neighbourhoods: how many vertices reach a vertex within t steps."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import low, spread_again, trailing_rank
from ..graph import Graph
from ..plans.lineage import counted, cut, drop


def hyperanf_exact(graph: Graph, steps: int = 4) -> DataFrame:
    """t, pairs: pairs (v, u) with u at most t steps before v, v itself included. For validation: it keeps the pairs."""
    edges = graph.edges.select("src", "dst").distinct()
    balls = graph.vertices.select("id", F.col("id").alias("u"))
    sizes = [(0, balls.count())]
    for t in range(1, steps + 1):
        further = balls.join(edges, balls.id == edges.src).select(F.col("dst").alias("id"), "u")
        balls, n = counted(balls.unionByName(further).distinct())
        sizes.append((t, n))
    return graph.spark.createDataFrame(sizes, "t int, pairs long")


def registers_log2(rsd: float) -> int:
    """Registers (as a power of two) that give the relative standard deviation asked for."""
    return math.ceil(math.log2((1.106 / rsd) ** 2))


def _alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


#: Ranks that a register can hold: a number of 32 bits says which have been seen, and its highest bit is the register's value.
RANKS = 31


def counters(graph: Graph, k: int) -> DataFrame:
    """id and a counter of 2^k registers, two in each of the columns w0, w1, ...: bit r of a register tells that rank r + 1 was seen."""
    m = 1 << k
    h = spread_again(low(F.col("id")) * 31 + 7)
    rows = graph.vertices.select("id", h.bitwiseAND(F.lit(m - 1)).cast("int").alias("at"), trailing_rank(F.shiftright(h, k), 32 - k).alias("rank"))
    bit = F.expr("shiftleft(1L, (at % 2) * 32 + rank - 1)")
    return rows.withColumn("bit", bit).select("id", *(F.when(F.floor(F.col("at") / 2) == i, F.col("bit")).otherwise(F.lit(0).cast("long")).alias(f"w{i}") for i in range(m // 2)))


#: The bit of each value of a register; none for 0.
BIT_OF = np.array([0, *(1 << r for r in range(32))], np.uint64)


def _width(m: int) -> int:
    """Bits that hold a register's value, of m registers: the ranks of what is left of 32 bits, and 0."""
    return (34 - m.bit_length()).bit_length()


def _size(m: int) -> int:
    """Bytes of a packed counter."""
    return -(-m * _width(m) // 8)


def _packed(values: np.ndarray) -> pa.Array:
    """A row of register values for each counter becomes bytes: the highest bits of all values, then the next ones. High bits are few, so a shuffle can compress them."""
    n, m = values.shape
    bits = np.concatenate([values >> j & 1 for j in reversed(range(_width(m)))], axis=1)
    held = np.packbits(bits, axis=1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(_size(m))), pa.py_buffer(held)])


def _unpacked(c: pa.Array, m: int) -> np.ndarray:
    held = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), _size(m))
    bits = np.unpackbits(held, axis=1, count=m * _width(m))
    values = bits[:, :m].copy()
    for i in range(1, _width(m)):
        values <<= 1
        values |= bits[:, i * m : (i + 1) * m]
    return values


def packed(state: DataFrame) -> DataFrame:
    """id, c: the counters by the values of their registers alone, five bits each."""
    words = [c for c in state.columns if c != "id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.empty((len(batch), 2 * len(words)), np.uint8)
            for i in range(len(words)):
                seen = batch.column(i + 1).to_numpy().view(np.uint64)
                for j, half in enumerate((seen & np.uint64(2**32 - 1), seen >> np.uint64(32))):
                    values[:, 2 * i + j] = np.frexp(half.astype(np.float64))[1]  # the place of the highest bit
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(values)], names=["id", "c"])

    return state.select("id", *words).mapInArrow(pack, "id long, c binary")


def spread_on(edges: DataFrame, state: DataFrame) -> DataFrame:
    """A step: every counter joins those of the vertices that point at it. One row travels along an edge, with five bits a register.

    The counters are never broadcast. A task takes those for a vertex one after the other, however many they are, and
    leaves the highest bit of each register.
    """
    words = [c for c in state.columns if c != "id"]
    own = packed(state)
    moved = edges.join(own.hint("merge"), edges.src == own.id).select(F.col("dst").alias("id"), "c")
    return gathered(own.unionByName(moved), words)


def gathered(counters: DataFrame, words: list[str]) -> DataFrame:
    """id and words: the union of the packed counters that each id has in ``counters`` (id, c)."""

    def rows(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        bits = BIT_OF[values]
        joint = bits[:, 0::2] | bits[:, 1::2] << np.uint64(32)
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.ascontiguousarray(joint[:, i]).view(np.int64)) for i in range(len(words)))], names=["id", *words])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            ids, values = batch.column(0).to_numpy(), _unpacked(batch.column(1), 2 * len(words))
            if held is not None:
                ids, values = np.concatenate([held[0], ids]), np.concatenate([held[1], values])
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            most = np.maximum.reduceat(values, starts, axis=0)
            if len(starts) > 1:
                yield rows(ids[starts[:-1]], most[:-1])
            held = ids[starts[-1:]], most[-1:]  # more may come for the last one
        if held is not None:
            yield rows(*held)

    return counters.repartition("id").sortWithinPartitions("id").mapInArrow(gather, ", ".join(f"{c} long" for c in ("id", *words)))


def spread_among(members: DataFrame, state: DataFrame) -> DataFrame:
    """A step over the graph whose edges join all members of a group: as ``spread_on`` over those edges, which are never made.

    ``members``: group, member. A group's counter is that of all its members, since a vertex keeps its own anyway; it goes
    back to the members that it tells something new. So a step moves two rows a member and not one an edge. A group may be
    longer than a batch: its counters are held packed, and read twice.
    """
    words = [c for c in state.columns if c != "id"]
    m = 2 * len(words)
    own = packed(state)
    none = F.lit(bytearray(_size(m)))  # a member that is no vertex has nothing to tell, but is told
    lines = members.join(own.hint("merge"), members.member == own.id, "left").select("group", "member", F.coalesce("c", none).alias("c"))

    def told(ids: np.ndarray, values: np.ndarray, joint: np.ndarray) -> pa.RecordBatch:
        news = (joint > values).any(axis=1)
        ids, joint = ids[news], joint[news]
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=ids[order][:1] - 1))
        if 2 * len(starts) <= len(ids):  # a vertex in many groups is told once a batch
            ids, joint = ids[order][starts], np.maximum.reduceat(joint[order], starts, axis=0) if len(starts) else joint
        return pa.RecordBatch.from_arrays([pa.array(ids), _packed(joint)], names=["id", "c"])

    def one(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of one group."""
        joint = np.max([_unpacked(p.column(2), m).max(axis=0) for p in pieces], axis=0)
        for p in pieces:
            yield told(p.column(1).to_numpy(), _unpacked(p.column(2), m), np.broadcast_to(joint, (len(p), m)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the pieces of the last group so far: more may come
        for batch in batches:
            if not len(batch):
                continue
            groups = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
            first, last = 0, int(starts[-1])
            if held and held[0].column(0)[0].as_py() == groups[0]:
                first = int(starts[1]) if last else len(batch)
                held.append(batch.slice(0, first))
                if first == len(batch):
                    continue
            if held:
                yield from one(held)
            if first < last:
                inner = batch.slice(first, last - first)
                values, at = _unpacked(inner.column(2), m), starts[(starts >= first) & (starts < last)] - first
                joint = np.maximum.reduceat(values, at, axis=0)
                yield told(inner.column(1).to_numpy(), values, np.repeat(joint, np.diff(at, append=len(inner)), axis=0))
            held = [batch.slice(last)]
        if held:
            yield from one(held)

    moved = lines.repartition("group").sortWithinPartitions("group").mapInArrow(meet, "id long, c binary")
    return gathered(own.unionByName(moved), words)


def registers(state: DataFrame) -> DataFrame:
    """id, register, value of the registers that are set."""
    words = [c for c in state.columns if c != "id"]
    halves = [(2 * i + j, F.col(w).bitwiseAND(F.lit(2**32 - 1)) if not j else F.shiftrightunsigned(w, 32)) for i, w in enumerate(words) for j in (0, 1)]
    rows = state.select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("register"), x.alias("seen")) for i, x in halves))).alias("r")).select("id", "r.register", "r.seen").where("seen <> 0")
    return rows.select("id", "register", F.length(F.bin("seen")).cast("int").alias("value"))


def estimates(state: DataFrame) -> DataFrame:
    """id, reach: the number of vertices that each counter tells of, row by row; held: the sum of its registers, which grows if any of them does."""
    words, m = [c for c in state.columns if c != "id"], 2 * (len(state.columns) - 1)
    halves = F.concat(F.transform("words", lambda w: w.bitwiseAND(F.lit(2**32 - 1))), F.transform("words", lambda w: F.shiftrightunsigned(w, 32)))
    seen = state.select("id", F.array(*words).alias("words")).select("id", halves.alias("seen"))
    share = F.transform("seen", lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -F.length(F.bin(x)))))  # powers of two: their sum is exact in any order
    per = seen.select("id", F.aggregate(share, F.lit(0.0), lambda a, b: a + b).alias("s"), F.size(F.filter("seen", lambda x: x == 0)).alias("empty"), F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + F.when(x == 0, 0).otherwise(F.length(F.bin(x)))).alias("held")).where(F.col("empty") < m)
    raw, empty = _alpha(m) * m * m / F.col("s"), F.col("empty")
    return per.select("id", F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("reach"), "held")


def hyperanf(graph: Graph, rsd: float = 0.1, max_steps: int | None = 100, epsilon: float = 0.001, to_the_end: bool = False) -> DataFrame:
    """t, estimate, seed and seed_reach from HyperLogLog counters, until the estimate grows by less than ``epsilon``.

    The estimate is the neighbourhood function, the seed the vertex with the largest reach (the least id on ties).
    A vertex has one row with its whole counter, and a step is one aggregation by bits. ``to_the_end`` goes on until a
    step, the last one told of, changes no counter. ``max_steps`` ends either; None for no limit.
    """
    edges = graph.by_source()
    out = _steps(counters(graph, registers_log2(rsd)), lambda state: spread_on(edges, state), max_steps, epsilon, to_the_end)
    edges.unpersist()
    return out


def hyperanf_of_groups(members: DataFrame, vertices: DataFrame, rsd: float = 0.1, max_steps: int | None = 100, epsilon: float = 0.001, to_the_end: bool = False) -> DataFrame:
    """``hyperanf`` over the graph whose edges join all members of a group, both ways. ``members``: group, member (null: none); ``vertices``: id."""
    members = members.select(F.col("group").cast("long").alias("group"), F.col("member").cast("long").alias("member")).where("group is not null and member is not null")
    graph = Graph(members.select(F.col("group").alias("src"), F.col("member").alias("dst")), vertices)
    dealt = members.repartition("member").sortWithinPartitions("member").persist(StorageLevel.MEMORY_AND_DISK)
    out = _steps(counters(graph, registers_log2(rsd)), lambda state: spread_among(dealt, state), max_steps, epsilon, to_the_end)
    dealt.unpersist()
    return out


def _steps(state: DataFrame, step: Callable[[DataFrame], DataFrame], max_steps: int | None, epsilon: float, to_the_end: bool) -> DataFrame:
    """Steps and what is told after each. Reaches are summed as decimals, so that the order of the rows does not matter."""
    state, sizes, held = cut(state), [], None
    for t in itertools.count():
        if t:
            after = cut(step(state))
            drop(state)
            state = after
        told = estimates(state).withColumn("reach", F.round("reach", 9)).agg(F.sum(F.col("reach").cast("decimal(28, 9)")).cast("double").alias("n"), F.sum("held").alias("held"), F.max(F.struct("reach", (-F.col("id")).alias("i"))).alias("top")).first()
        sizes.append((t, told["n"] or 0.0, -told["top"]["i"] if told["top"] else None, told["top"]["reach"] if told["top"] else None))
        still = t and told["held"] == held
        near = t and not to_the_end and sizes[-2][1] and abs(sizes[-1][1] - sizes[-2][1]) / sizes[-2][1] < epsilon
        if still or near or t == max_steps:
            break
        held = told["held"]
    drop(state)
    return state.sparkSession.createDataFrame(sizes, "t int, estimate double, seed long, seed_reach double")


def hll_registers(graph: Graph, steps: int, rsd: float = 0.1) -> DataFrame:
    """id, register, value after ``steps`` steps. For validation: a vertex has a row for each register that is set."""
    k = registers_log2(rsd)
    h = spread_again(low(F.col("id")) * 31 + 7)
    state = graph.vertices.select("id", h.bitwiseAND(F.lit((1 << k) - 1)).cast("int").alias("register"), trailing_rank(F.shiftright(h, k), 32 - k).alias("value"))
    for _ in range(steps):
        moved = graph.edges.join(state, graph.edges.src == state.id).select(F.col("dst").alias("id"), "register", "value")
        after = cut(state.unionByName(moved).groupBy("id", "register").agg(F.max("value").alias("value")))
        drop(state)
        state = after
    return state
