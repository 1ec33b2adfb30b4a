"""An evolving edge store with versions: appends, deletions and purges that are whole or not there at all.

A version is a manifest, a small file that names the folders of edges, of filter slices and of deletion vectors that
make it up. Folders are written under new names and never changed; the manifest is written beside its place and
renamed into it, which fails if another writer has made that version. So edges and filters change together, a reader
keeps the version that it opened, and a writer that dies leaves the last version as it was (and folders that no
manifest names, which ``vacuum`` removes).

Deleting writes bitmaps: for each page that loses edges, words of 64 bits that tell which of its rows are gone. Edges
and filters stay (filters may say too much, never too little) until ``purge`` folds the bitmaps in.

Within a folder rows lie in order in small row groups, so that a filter on ranges of pages is answered by their
statistics: a selective read asks for the hit pages as few coalesced ranges.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..graph import Graph
from ..plans.lineage import counted, cut, drop, remove, work_path
from ..plans.superstep import MonotoneProgram, Result, run_monotone
from .pageindex import BITS, MAX_CHECK, PER_PAGE, filters, paged, probe

#: Bytes of a row group (some 100,000 edges), hit pages that are listed in a filter, and ranges that they are given as at most.
ROW_GROUP, LISTED, RANGES = 1 << 20, 10_000, 200
#: Words of deletion vectors that may be broadcast (24 bytes each).
BROADCAST_WORDS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _written(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file whole under another name and renames it; fails if the name is taken."""
    jvm = spark.sparkContext._jvm
    where, files = _files(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(where), options)
    except Exception as failed:
        files.delete(aside, False)
        if files.exists(where):
            raise Conflict(path) from failed
        raise


def coalesced(pages: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Sorted pages as at most ``most`` runs (first, last): the widest gaps between neighbours stay open."""
    gaps = sorted((b - a for a, b in zip(pages, pages[1:])), reverse=True)
    least = max(2, gaps[most - 1] + 1) if len(gaps) >= most else 2
    runs: list[tuple[int, int]] = []
    for page in pages:
        if runs and page - runs[-1][1] < least:
            runs[-1] = (runs[-1][0], page)
        else:
            runs.append((page, page))
    return runs


def in_ranges(pages: list[int]) -> Column:
    """A condition on ``page_id`` that the statistics of row groups can answer."""
    found = [F.col("page_id").between(a, b) for a, b in coalesced(pages)]
    while len(found) > 1:  # a balanced tree: plans are walked in recursion
        found = [a | b for a, b in zip(found[::2], [*found[1::2], F.lit(False)])]
    return found[0] if found else F.lit(False)


@dataclass(frozen=True)
class Snapshot:
    """A version as it was when it was made, whatever is written later."""

    store: "EdgeStore"
    version: int
    parts: tuple[str, ...]
    deleted: tuple[str, ...]
    rows: int
    _kept: dict = field(default_factory=dict, repr=False, compare=False)

    def _once(self, name: str, make: Callable):
        """What is made of a version's files is made once: they never change."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def _read(self, kind: str, names: tuple[str, ...]) -> DataFrame:
        if not names:
            return self.store.spark.createDataFrame([], {"edges": "src long, dst long, row long, page_id long", "slices": "bit int, block long, pages long"}[kind])
        return self.store.spark.read.parquet(*(f"{self.store.path}/{kind}/{n}" for n in names))

    @property
    def stored(self) -> DataFrame:
        """All edges of the version's folders with row and page_id, deleted ones too."""
        return self._once("edges", lambda: self._read("edges", self.parts))

    @property
    def index(self) -> DataFrame:
        return self._once("slices", lambda: self._read("slices", self.parts))

    def _gone(self) -> tuple[DataFrame, int]:
        """page_id, word, bits: the deletion vectors of all deletions put together, and how many words they are."""
        words = self._read("deleted", self.deleted).groupBy("page_id", "word").agg(F.bit_or("bits").alias("bits"))
        return counted(words, "gone")

    def live(self, edges: DataFrame) -> DataFrame:
        """The edges whose bit is not set in the deletion vectors."""
        if not self.deleted:
            return edges
        gone, n = self._once("gone", self._gone)
        place = edges.withColumn("_at", (F.col("row") - F.col("page_id") * self.store.per_page).cast("int")).withColumn("_word", F.expr("_at div 64").cast("int"))
        gone = gone.select(F.col("page_id").alias("_page"), F.col("word").alias("_w"), "bits")
        marked = place.join(F.broadcast(gone) if n <= BROADCAST_WORDS else gone, (F.col("page_id") == F.col("_page")) & (F.col("_word") == F.col("_w")), "left")
        return marked.where("bits is null or getbit(bits, _at % 64) = 0").select(*edges.columns)

    @property
    def edges(self) -> DataFrame:
        """The edges of the version, with row and page_id."""
        return self.live(self.stored)

    def scan(self, frontier: DataFrame) -> DataFrame:
        """The live edges of the pages that the frontier (id) may be a source in.

        Up to ``LISTED`` hit pages are a filter, as ranges that the files' statistics answer and as a list; more are joined.
        """
        hit = probe(self.index, frontier, self.store.bits)
        pages = sorted(r.page_id for r in hit.limit(LISTED + 1).collect())
        if len(pages) <= LISTED:
            return self.live(self.stored.where(in_ranges(pages)).where(F.col("page_id").isin(pages)))
        return self.live(self.stored.join(hit, "page_id", "left_semi"))

    def run(self, graph: Graph, program: MonotoneProgram, max_check: int = MAX_CHECK) -> Result:
        """As ``run_monotone`` over the edges of this version, read by their filters while the frontier is small."""
        return run_monotone(graph, program, edges=self.edges, select=lambda frontier, active, phase: self.scan(frontier) if 1 < active < max_check else self.edges)


@dataclass
class EdgeStore:
    """A folder of versions. ``per_page`` rows are a page, ``bits`` the size of its filter."""

    spark: SparkSession
    path: str
    per_page: int = PER_PAGE
    bits: int = BITS

    @classmethod
    def create(cls, edges: DataFrame, *order: Column | str, path: str | None = None, per_page: int = PER_PAGE, bits: int = BITS) -> "EdgeStore":
        """A store whose version 1 has these edges in the order given (source, target, then all else)."""
        store = cls(edges.sparkSession, path or work_path(edges.sparkSession, "store"), per_page, bits)
        part, n = store._part(edges, order, 0)
        store._commit(1, [part] if n else [], [], n)
        return store

    # versions

    def versions(self) -> list[int]:
        where, files = _files(self.spark, f"{self.path}/versions")
        if not files.exists(where):
            return []
        names = (s.getPath().getName() for s in files.listStatus(where))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest if none is named."""
        have = self.versions()
        version = have[-1] if version is None else version
        if version not in have:
            raise ValueError(f"no version {version} in {self.path}")
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).collect())
        held = json.loads(text)
        return Snapshot(self, version, tuple(held["parts"]), tuple(held["deleted"]), held["rows"])

    def _commit(self, version: int, parts: list[str], deleted: list[str], rows: int) -> Snapshot:
        _written(self.spark, f"{self.path}/versions/{version:012d}.json", json.dumps({"parts": parts, "deleted": deleted, "rows": rows, "per_page": self.per_page, "bits": self.bits}))
        return Snapshot(self, version, tuple(parts), tuple(deleted), rows)

    # writing

    def _part(self, edges: DataFrame, order: tuple, first_row: int) -> tuple[str, int]:
        """Writes edges and their slices under a new name, the edges in runs of pages; and how many there are."""
        name = uuid.uuid4().hex
        rows = cut(paged(edges, *order, per_page=self.per_page, first_row=first_row).drop("_row"), "paged")
        n = rows.count()
        if n:
            laid = rows.repartitionByRange("page_id").sortWithinPartitions("row")
            laid.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/edges/{name}")
            filters(rows, self.bits).repartitionByRange("bit").sortWithinPartitions("bit", "block").write.parquet(f"{self.path}/slices/{name}")
        drop(rows)
        return name, n

    def append(self, more: DataFrame, *order: Column | str) -> Snapshot:
        """A version with these edges after those of the newest."""
        last = self.snapshot()
        part, n = self._part(more, order, last.rows)
        return self._commit(last.version + 1, [*last.parts, part] if n else list(last.parts), list(last.deleted), last.rows + n)

    def delete(self, which: Column | DataFrame) -> Snapshot:
        """A version without the edges that a condition holds for, or that are named by (src, dst). Writes a bitmap for each page that loses some."""
        last, name = self.snapshot(), uuid.uuid4().hex
        if not last.parts:
            return self._commit(last.version + 1, [], [], last.rows)
        edges = last.edges
        lost = edges.join(which.select("src", "dst").distinct(), ["src", "dst"], "left_semi") if isinstance(which, DataFrame) else edges.where(F.coalesce(which, F.lit(False)))
        at = lost.select("page_id", (F.col("row") - F.col("page_id") * self.per_page).cast("int").alias("at"))
        words = at.groupBy("page_id", F.expr("at div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
        words.write.parquet(f"{self.path}/deleted/{name}")
        return self._commit(last.version + 1, list(last.parts), [*last.deleted, name], last.rows)

    def purge(self) -> Snapshot:
        """A version with the live edges alone, in new pages with new filters, in the order that they had."""
        last = self.snapshot()
        if not last.parts:
            return self._commit(last.version + 1, [], [], 0)
        part, n = self._part(last.edges.drop("page_id").withColumnRenamed("row", "_row"), ("_row",), 0)
        return self._commit(last.version + 1, [part] if n else [], [], n)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the ``keep`` newest versions, and folders that none of these names. For when no writer is at work."""
        have = self.versions()
        kept = [self.snapshot(v) for v in have[-keep:]]
        for version in have[:-keep]:
            remove(self.spark, f"{self.path}/versions/{version:012d}.json")
        named = {n for s in kept for n in (*s.parts, *s.deleted)}
        gone = []
        for kind in ("edges", "slices", "deleted"):
            where, files = _files(self.spark, f"{self.path}/{kind}")
            for status in files.listStatus(where) if files.exists(where) else []:
                if (name := status.getPath().getName()) not in named:
                    gone.append(f"{kind}/{name}")
                    remove(self.spark, f"{self.path}/{kind}/{name}")
        return gone
