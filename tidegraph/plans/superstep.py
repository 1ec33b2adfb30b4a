"""The vertex-program surface: scatter along edges, gather at targets, until nothing changes.

A program is Column expressions. ``VertexProgram`` rewrites the whole state in each superstep and may
do anything; ``MonotoneProgram`` keeps one ordered value for each vertex that only ever falls, so that
a superstep touches the changed vertices alone and adds rows to a log of values instead of rewriting
the state. ``BatchProgram`` is a vertex program whose scatter and gather are Python functions over Arrow
batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from ..graph import Graph
from .accounting import accounted
from .lineage import counted, cut, drop, observed, union


@dataclass(frozen=True)
class Superstep:
    """What a superstep did: vertices that sent, vertices that changed, targets that got a message (-1: not counted), seconds."""

    phase: int
    active: int
    changed: int
    arrived: int = -1
    seconds: float = 0.0
    observed: dict = field(default_factory=dict)


@dataclass
class Result:
    state: DataFrame
    steps: list[Superstep] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        """A row for each superstep."""
        told = [s if isinstance(s, dict) else {k: v for k, v in vars(s).items() if k != "observed"} | s.observed for s in self.steps]
        return self.state.sparkSession.createDataFrame([Row(**t) for t in told], None if told else "phase long, active long, changed long, arrived long, seconds double")


@dataclass(frozen=True)
class MonotoneProgram:
    """``start``: id and value v of the vertices that begin. ``message``: the value that an edge (src, dst, weight) sends, given v of its source.

    Values are compared as wholes; structs field by field. The least message wins, and is taken if it
    is less than what the vertex has. ``first_only``: a vertex never changes once it has a value, and values
    that come later are never less (a level, or the same everywhere). ``metrics``: aggregates over the rows (id, v)
    that a superstep changes, taken as they are written; supersteps then run one by one.
    """

    start: DataFrame
    message: Callable[[], Column]
    first_only: bool = False
    max_steps: int = 10_000
    metrics: dict[str, Column] = field(default_factory=dict)


#: Active vertices up to which a superstep hands them to every task (16 bytes or so each) instead of shuffling.
SMALL_FRONTIER = 100_000
#: Active vertices up to which their ids become a filter on the edges, which lie in the order of their sources.
FEW = 200
#: Steps that a plan goes ahead in a small graph, and active vertices up to which it does.
AHEAD, SHORT = 3, 10_000
#: Supersteps whose changes are kept side by side before they become one table.
LOG = 12
#: Values from which on known ones are looked up by the ids that got a message, and values for each folder of a table of them.
MANY, FOLDER = 100_000, 2_000_000


class Known:
    """The values that vertices have had: those of the newest supersteps in tables of their own, older ones in tables that grow by merging.

    A large table lies in folders by a hash of the ids, so that few ids read few folders.
    """

    def __init__(self, first_only: bool):
        self.first_only, self.recent, self.tables = first_only, [], []

    @property
    def rows(self) -> int:
        return sum(n for _, n, _ in self.tables) + sum(n for _, n in self.recent)

    def add(self, values: DataFrame, n: int) -> None:
        self.recent.append((values, n))

    def _merged(self, frames: list[DataFrame]) -> DataFrame:
        out = union([f.select("id", "v") for f in frames])
        return out if self.first_only or len(frames) == 1 else out.groupBy("id").agg(F.min("v").alias("v"))

    def settle(self) -> None:
        """Writes the newest values as a table, together with the tables that are not much larger."""
        frames, n = [f for f, _ in self.recent], sum(n for _, n in self.recent)
        gone = []
        while self.tables and self.tables[-1][1] <= 2 * n:
            table, m, _ = self.tables.pop()
            gone.append(table)
            n += m
        merged, folders = self._merged([*frames, *gone]), -(-n // FOLDER)
        if folders > 1:
            merged = merged.withColumn("folder", F.pmod(F.hash("id"), F.lit(folders))).repartition("folder")
        table, n = counted(merged, "values", ["folder"] if folders > 1 else None)
        self.tables.append((table, n, folders))
        drop(*frames, *gone)
        self.recent = []

    def of(self, wanted: DataFrame | None, n: int) -> DataFrame:
        """Values of the ``n`` wanted ids (of all if None)."""
        frames = [f for f, _ in self.recent]
        for table, _, folders in self.tables:
            if wanted is not None and folders > 1 and n < 4 * folders:
                here = [r[0] for r in wanted.select(F.pmod(F.hash("id"), F.lit(folders)).alias("f")).distinct().collect()]  # at most one a folder
                table = table.where(F.col("folder").isin(here))
            frames.append(table)
        found = union([f.select("id", "v") for f in frames])
        if wanted is not None and n <= SMALL_FRONTIER:
            found = found.join(F.broadcast(wanted.select("id")), "id", "left_semi")
        return found

    def state(self) -> DataFrame:
        """Every vertex that has a value, with its least."""
        if self.recent:
            self.settle()
        tables = [t for t, _, _ in self.tables]
        return self._merged(tables).select("id", "v")


def run_monotone(graph: Graph, program: MonotoneProgram, edges: DataFrame | None = None, select: Callable[[DataFrame, int, int], DataFrame] | None = None, ahead: int = AHEAD, measured: bool = False) -> Result:
    """Runs to the fixpoint. ``select(frontier, count, phase)`` may choose the edges to scan in place of all.
    ``measured``: metrics tell of each superstep's messages, and of its bytes, rows and task time (``accounting.Cost``).

    A superstep reads by its frontier: in a large graph few active vertices are a filter on the edges, and of
    the known values only those of the ids that got a message are read. In a small one, where a superstep is
    mostly overhead, a plan goes ``ahead`` by several steps while the frontier is small: what it sends on from
    vertices that had a better value is never taken.
    """
    borrowed, edges = edges, graph.by_source() if edges is None else edges
    if program.metrics or measured:
        ahead = 1
    frontier, active = counted(program.start.select("id", "v"))
    known, steps, phase = Known(program.first_only), [], 0
    known.add(frontier, active)

    def sent(scanned: DataFrame, senders: DataFrame) -> DataFrame:
        got = scanned.join(senders, scanned.src == senders.id)
        return got.select(F.col("dst").alias("id"), program.message().alias("v")).groupBy("id").agg(F.min("v").alias("v"), *([F.count(F.lit(1)).alias("n")] if measured else []))

    def step() -> tuple[DataFrame, int, int, dict]:
        """The vertices that change, their number, that of the targets, and what is told of the superstep."""
        wide = known.rows > MANY
        scanned, senders = select(frontier, active, phase) if select else edges, frontier
        if wide and active <= FEW and select is None:
            scanned = scanned.where(F.col("src").isin([r.id for r in frontier.select("id").collect()]))
        best, arrived = sent(scanned, F.broadcast(senders) if active <= SMALL_FRONTIER else senders), -1
        if ahead > 1 and not wide and active <= SHORT and select is None:
            layers = [best]
            while len(layers) < ahead:
                layers.append(sent(edges, layers[-1]))
            best = union(layers).groupBy("id").agg(F.min("v").alias("v"))
        extra = {}
        if measured:
            best, extra = observed(best, {"arrived": F.count(F.lit(1)), "messages": F.coalesce(F.sum("n"), F.lit(0))}, "arrived")
            arrived = extra.pop("arrived")
        elif wide:
            best, arrived = counted(best, "arrived")
        had = known.of(best if wide else None, arrived)
        if program.first_only:
            fresh = best.join(had, "id", "left_anti").select("id", "v")
        else:
            fresh = best.join(had.groupBy("id").agg(F.min("v").alias("old")), "id", "left").where("old is null or v < old").select("id", "v")
        after, told = observed(fresh, {"_changed": F.count(F.lit(1))} | program.metrics)
        changed = told.pop("_changed")
        if wide or measured:
            drop(best)
        if len(known.recent) >= LOG:
            known.settle()
        known.add(after, changed)
        return after, changed, arrived, extra | told

    while active and phase < program.max_steps:
        began = time.perf_counter()
        if measured:
            with accounted(graph.spark) as cost:
                frontier, changed, arrived, told = step()
            told |= vars(cost)
        else:
            frontier, changed, arrived, told = step()
        steps.append(Superstep(phase, active, changed, arrived, round(time.perf_counter() - began, 3), told))
        active, phase = changed, phase + 1
    state = known.state()
    if borrowed is None:
        edges.unpersist()
    return Result(state, steps)


@dataclass(frozen=True)
class VertexProgram:
    """A synchronous program over whole states.

    ``init``: state columns from ``id``. ``active``: which vertices send, from the state (a Column, or of the phase). ``message``:
    what an edge sends, from the source's state and src, dst, weight. ``combine``: aggregates over the
    messages of a target. ``apply``: new state columns from the old ones, the combined ones (null: no message) and id.
    """

    init: dict[str, Column]
    message: dict[str, Column]
    combine: dict[str, Column]
    apply: dict[str, Column]
    active: Column | None = None
    emit: Column | None = None
    phases: int = 1
    metrics: dict[str, Column] = field(default_factory=dict)


def run(graph: Graph, program: VertexProgram, edges: DataFrame | None = None) -> Result:
    """Runs at most ``phases`` supersteps, fewer if none is active."""
    borrowed, edges = edges, graph.by_source() if edges is None else edges
    state, steps = cut(graph.vertices.select("id", *(c.alias(n) for n, c in program.init.items()))), []
    for phase in range(program.phases):
        senders = state if program.active is None else state.where(program.active)
        if program.active is not None and senders.isEmpty():
            break
        sent = edges.join(senders, edges.src == senders.id)
        if program.emit is not None:
            sent = sent.where(program.emit)
        got = sent.select(F.col("dst").alias("_to"), *(c.alias(n) for n, c in program.message.items()))
        got = got.groupBy("_to").agg(*(c.alias(n) for n, c in program.combine.items()))
        after, told = observed(state.join(got, state.id == got._to, "left").select("id", *(c.alias(n) for n, c in program.apply.items())), program.metrics)
        drop(state)
        state = after
        if program.metrics:
            steps.append({"phase": phase} | told)
    if borrowed is None:
        edges.unpersist()
    return Result(state, steps)


@dataclass(frozen=True)
class BatchProgram:
    """A synchronous program in Python, a batch of rows at a time.

    ``scatter``: from a batch of edges with the state of their sources (src, dst, weight if there is one, and
    the state's columns) a batch of messages. ``combine``: aggregates over the messages of a target, on Spark's
    side. ``gather``: from a batch of the old state beside the combined messages (null: none came) the batch of
    the next state. ``state`` and ``messages`` are schemas; a state has ``id``, a message ``dst``.
    """

    init: dict[str, Column]
    state: str
    messages: str
    scatter: Callable[[pa.RecordBatch], pa.RecordBatch]
    combine: dict[str, Column]
    gather: Callable[[pa.RecordBatch], pa.RecordBatch]
    active: Column | None = None
    phases: int = 1


def run_batches(graph: Graph, program: BatchProgram) -> Result:
    """Runs at most ``phases`` supersteps, fewer if none is active."""
    edges = graph.by_source()

    def each(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: map(f, batches)

    state, steps = cut(graph.vertices.select("id", *(c.alias(n) for n, c in program.init.items()))), []
    for phase in range(program.phases):
        senders = state if program.active is None else state.where(program.active)
        if program.active is not None and senders.isEmpty():
            break
        began = time.perf_counter()
        messages = edges.join(senders.withColumnRenamed("id", "src"), "src").mapInArrow(each(program.scatter), program.messages)
        got = messages.groupBy("dst").agg(*(c.alias(n) for n, c in program.combine.items()))
        after = cut(state.join(got.withColumnRenamed("dst", "id"), "id", "left").mapInArrow(each(program.gather), program.state))
        drop(state)
        state = after
        steps.append({"phase": phase, "seconds": round(time.perf_counter() - began, 3)})
    edges.unpersist()
    return Result(state, steps)
