"""Bloom filters over pages of the edge list, and supersteps that read only the pages that may matter.

A page is a run of ``per_page`` edges in stored order. Its filter holds four bits of each source in it. The
filters of ``GROUP`` pages are kept as bit slices: for each bit that any of them has set, one number whose
bits say which pages have it, (bit, block, pages), in the order of the bits. A probe reads the slices of the
bits that it asks for and no others: a vertex may be in the pages that are in all its slices. Pages with a
frontier source always are hit, others may be. A task looks up a part of the frontier in the slices of ``BAND``
blocks, and stops where all of their pages are hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import bloom_positions
from ..graph import Graph
from ..plans.lineage import cut, drop, work_path
from ..plans.superstep import MonotoneProgram, Result, run_monotone
from .sorting import numbered

PER_PAGE, BITS, GROUP = 256, 1024, 64
#: Blocks whose slices a task looks at together, parts that a frontier is dealt over, and ids looked up at once.
BAND, SHARES, AT_ONCE = 64, 8, 2048
#: Pages in a folder of the stored edges (some two million edges): folders without a hit page are not opened.
PAGES_PER_FOLDER = 8192
#: Frontiers over this many vertices read all pages.
MAX_CHECK = 600_000
#: Hit pages that may be broadcast (16 bytes each).
BROADCAST_PAGES = 1_000_000


def paged(edges: DataFrame, *order: Column | str, per_page: int = PER_PAGE, first_row: int = 0) -> DataFrame:
    """Edges with ``row`` and ``page_id`` in the order given (source, target, then all else)."""
    order = order or tuple(c for c in ("src", "dst", "weight") if c in edges.columns)
    rows = numbered(edges, *order).withColumn("row", F.col("row") + first_row)
    return rows.withColumn("page_id", F.floor(F.col("row") / per_page).cast("long"))


def filters(edges: DataFrame, bits: int = BITS) -> DataFrame:
    """bit, block, pages: the slices of all filters. Deleted edges are left out."""
    live = edges.where(~F.col("is_deleted")) if "is_deleted" in edges.columns else edges
    there = F.expr(f"shiftleft(1L, CAST(page_id % {GROUP} AS INT))")
    found = live.select(F.explode(bloom_positions(F.col("src"), bits)).alias("bit"), F.floor(F.col("page_id") / GROUP).cast("long").alias("block"), there.alias("page"))
    return found.groupBy("bit", "block").agg(F.bit_or("page").alias("pages"))


def pages_of(slices: DataFrame) -> DataFrame:
    """Rows (.., block, pages) become a row with ``page_id`` for each page."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda i: F.getbit("pages", i) == 1))
    rest = [c for c in slices.columns if c not in ("block", "pages")]
    return slices.select(*rest, "block", at.alias("_at")).select((F.col("block") * GROUP + F.col("_at")).alias("page_id"), *rest)


def pages_hit(sources: DataFrame, frontier: DataFrame, *order: Column | str, bits: int = BITS, per_page: int = PER_PAGE) -> DataFrame:
    """pages, hit, holding: what an order of the edges by their sources is worth to a frontier. ``sources``: src and n, the number of its edges.

    Of all pages, those that a probe says may hold a source of the frontier, and those that do. Edges that
    lie by source keep a vertex's edges together, but a page's filter fills up with unlike bits and is hit in
    error; ``sorting.source_keys`` put sources with like bits into one page. The edges of a source follow each
    other in either, so its first place and their number say which pages it is in, and edges are not sorted.
    """
    runs = numbered(sources, *order, size="n")
    page = lambda row: F.floor(row / per_page).cast("long")
    stored = cut(runs.select("src", F.explode(F.sequence(page(F.col("row")), page(F.col("row") + F.col("n") - 1))).alias("page_id")), "runs")
    n = stored.agg((F.coalesce(F.max("page_id"), F.lit(-1)) + 1).alias("pages"))
    hit = probe(filters(stored, bits), frontier, bits).agg(F.count("*").alias("hit"))
    holding = stored.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi").agg(F.count_distinct("page_id").alias("holding"))
    return n.crossJoin(hit).crossJoin(holding)  # a row each


def probe(index: DataFrame, frontier: DataFrame, bits: int = BITS) -> DataFrame:
    """page_id of the pages that the ids of the frontier hit. A slice may come in several rows.

    The places of the frontier (16 bytes an id) are broadcast in ``SHARES`` rows.
    """
    wanted = frontier.where("id is not null").select(bloom_positions(F.col("id"), bits).alias("at")).distinct()
    shares = wanted.groupBy(F.pmod(F.xxhash64("at"), F.lit(SHARES)).alias("share")).agg(F.flatten(F.collect_list("at")).alias("places")).select("places")
    whole = index.join(wanted.select(F.explode("at").alias("bit")).distinct(), "bit", "left_semi").groupBy("bit", "block").agg(F.bit_or("pages").alias("pages"))
    bands = whole.groupBy(F.floor(F.col("block") / BAND).alias("band")).agg(F.collect_list(F.struct("bit", (F.col("block") % BAND).cast("int").alias("nth"), "pages")).alias("slices"))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, slices, places in zip(*(batch.column(i) for i in range(3))):
                bit, nth, pages = (slices.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                table = np.zeros((bits, BAND), np.int64)
                table[bit, nth] = pages
                every, found = np.bitwise_or.reduce(table, axis=0), np.zeros(BAND, np.int64)
                places = places.values.to_numpy(zero_copy_only=False).reshape(-1, 4)
                for at in range(0, len(places), AT_ONCE):
                    a, b, c, d = places[at : at + AT_ONCE].T
                    found |= np.bitwise_or.reduce(table[a] & table[b] & table[c] & table[d], axis=0)
                    if (found == every).all():
                        break
                hit = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(hit + band.as_py() * BAND, pa.int64()), pa.array(found[hit], pa.int64())], names=["block", "pages"])

    found = bands.crossJoin(F.broadcast(shares)).mapInArrow(looked_up, "block long, pages long")
    return pages_of(found.groupBy("block").agg(F.bit_or("pages").alias("pages"))).select("page_id")


@dataclass
class PageIndex:
    """Stored edges with their filters."""

    spark: SparkSession
    path: str
    per_page: int = PER_PAGE
    bits: int = BITS
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def create(cls, edges: DataFrame, *order: Column | str, path: str | None = None, per_page: int = PER_PAGE, bits: int = BITS) -> "PageIndex":
        index = cls(edges.sparkSession, path or work_path(edges.sparkSession, "pages"), per_page, bits)
        index._write(paged(edges, *order, per_page=per_page), "overwrite")
        index._write_slices(filters(index.edges, bits), "overwrite")
        return index

    load = classmethod(lambda cls, spark, path, per_page=PER_PAGE, bits=BITS: cls(spark, path, per_page, bits))

    def _write(self, edges: DataFrame, mode: str) -> None:
        foldered = edges.withColumn("folder", F.floor(F.col("page_id") / PAGES_PER_FOLDER).cast("long"))
        foldered.repartition("folder").sortWithinPartitions("folder", "row").write.mode(mode).partitionBy("folder").parquet(f"{self.path}/edges")
        self._read.pop("edges", None)

    def _write_slices(self, slices: DataFrame, mode: str) -> None:
        slices.repartitionByRange("bit").sortWithinPartitions("bit", "block").write.mode(mode).parquet(f"{self.path}/index")
        self._read.pop("index", None)

    def _table(self, name: str) -> DataFrame:
        """A stored table; its files are listed once, until it changes."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._read[name]

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def index(self) -> DataFrame:
        """The slices; one may come in several rows, of which each says something."""
        return self._table("index")

    def filters(self) -> DataFrame:
        """page_id, bit of all bits that the stored filters have set."""
        return pages_of(self.index.groupBy("bit", "block").agg(F.bit_or("pages").alias("pages"))).select("page_id", "bit")

    def verify(self) -> bool:
        """Whether the stored filters are those of the stored edges (deleted ones left out)."""
        built, stored = filters(self.edges, self.bits), self.index.groupBy("bit", "block").agg(F.bit_or("pages").alias("pages"))
        apart = built.join(stored.withColumnRenamed("pages", "other"), ["bit", "block"], "full").where(~F.col("pages").eqNullSafe(F.col("other")))
        return apart.isEmpty()

    def append(self, more: DataFrame, *order: Column | str) -> None:
        """Adds edges after the stored ones and the slices of the pages that they fill."""
        last = self.edges.agg(F.max("row")).first()[0]
        first_row = 0 if last is None else last + 1
        added = paged(more, *order, per_page=self.per_page, first_row=first_row)
        added = cut(added.withColumn("is_deleted", F.lit(False)) if "is_deleted" in self.edges.columns else added)
        self._write_slices(filters(added, self.bits), "append")  # first: slices of pages that are not there do no harm
        self._write(added, "append")
        drop(added)

    def delete(self, which: Column) -> None:
        """Marks stored edges as deleted. They keep their places, and the filters stay as they are: they may say too much, never too little."""
        was = F.col("is_deleted") if "is_deleted" in self.edges.columns else F.lit(False)
        marked = cut(self.edges.drop("folder").withColumn("is_deleted", was | F.coalesce(which, F.lit(False))))
        self._write(marked, "overwrite")
        drop(marked)

    def rebuild(self) -> None:
        """Makes the filters anew from the edges that are left."""
        self._write_slices(cut(filters(self.edges, self.bits)), "overwrite")

    def _live(self, edges: DataFrame) -> DataFrame:
        return edges.where("not is_deleted") if "is_deleted" in edges.columns else edges

    def scan(self, frontier: DataFrame) -> DataFrame:
        """The live edges of the pages that the frontier hits. Folders without one are pruned by the join."""
        hit = cut(probe(self.index, frontier, self.bits).withColumn("folder", F.floor(F.col("page_id") / PAGES_PER_FOLDER).cast("long")))
        hit, few = hit.where("page_id >= 0"), hit.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
        return self._live(self.edges.join(F.broadcast(hit) if few else hit, ["folder", "page_id"], "left_semi"))

    def select(self, max_check: int = MAX_CHECK, min_phase: int = 0):
        """For ``run_monotone``: reads by the index while the frontier is small (and not a single vertex), else all edges."""

        def choose(frontier: DataFrame, active: int, phase: int) -> DataFrame:
            if phase >= min_phase and 1 < active < max_check:
                return self.scan(frontier)
            return self._live(self.edges)

        return choose


def run_selective(graph: Graph, program: MonotoneProgram, index: PageIndex, max_check: int = MAX_CHECK) -> Result:
    """As ``run_monotone``, reading the stored edges by their filters."""
    return run_monotone(graph, program, edges=index.edges, select=index.select(max_check))
