"""Versions of an evolving store: snapshots, deletion vectors, writers that die, page ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.operators import store as st, traversal

rng = random.Random(8)
EDGES = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(900)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def size(spark, path):
    where, files = st._files(spark, path)
    return files.getContentSummary(where).getLength()


def test_versions_stay_as_they_were(spark, tmp_path):
    store = st.EdgeStore.create(frame(spark, EDGES[:700]), path=str(tmp_path / "s"), per_page=100, bits=512)
    first = store.snapshot()
    store.append(frame(spark, EDGES[700:]))
    store.delete(F.col("src") % 3 == 0)
    third = store.delete(frame(spark, EDGES[10:40]))
    left = [e for i, e in enumerate(EDGES) if e[0] % 3 and not 10 <= i < 40]
    assert store.versions() == [1, 2, 3, 4] and pairs(first.edges) == EDGES[:700] and pairs(third.edges) == left
    rows = {(r.src, r.dst): (r.row, r.page_id) for r in third.edges.collect()}
    assert all(rows[e] == (EDGES.index(e), EDGES.index(e) // 100) for e in left)  # what is left keeps its place
    purged = store.purge()
    assert pairs(purged.edges) == left and purged.deleted == () and sorted(r.row for r in purged.edges.collect()) == list(range(len(left)))
    assert pairs(store.snapshot(2).edges) == EDGES and pairs(third.edges) == left
    gone = store.vacuum(keep=1)
    assert len(gone) == 6 and store.versions() == [5] and pairs(store.snapshot().edges) == left
    with pytest.raises(ValueError):
        store.snapshot(2)


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    store = st.EdgeStore.create(frame(spark, EDGES[:300]), path=str(tmp_path / "s"), per_page=64)

    def dies(*_, **__):
        raise OSError("the writer is gone")

    for broken in ("filters", "_written"):  # between edges and slices, and before the version is named
        with monkeypatch.context() as m:
            m.setattr(st, broken, dies)
            with pytest.raises(OSError):
                store.append(frame(spark, EDGES[300:]))
            with pytest.raises(OSError):
                store.purge()
    again = st.EdgeStore(spark, store.path, per_page=64)
    assert again.versions() == [1] and pairs(again.snapshot().edges) == EDGES[:300]
    found = again.snapshot().scan(frame(spark, [(v, 0) for v in range(200)]).select(F.col("src").alias("id")))
    assert pairs(found) == EDGES[:300]  # no edge without its slice
    again.append(frame(spark, EDGES[300:]))
    assert pairs(again.snapshot().edges) == EDGES and len(again.vacuum()) >= 2


def test_one_of_two_writers_wins(spark, tmp_path):
    store = st.EdgeStore.create(frame(spark, EDGES[:50]), path=str(tmp_path / "s"))
    last = store.snapshot()
    store._commit(2, list(last.parts), [], last.rows)
    with pytest.raises(st.Conflict):
        store._commit(2, [], [], 0)
    assert pairs(store.snapshot().edges) == EDGES[:50]


def test_a_deletion_writes_what_it_deletes(spark, tmp_path):
    many = spark.range(200_000).select((F.col("id") % 5000).alias("src"), F.col("id").alias("dst"))
    store = st.EdgeStore.create(many, path=str(tmp_path / "s"))
    before = size(spark, store.path)
    few = store.delete(F.col("dst").between(100, 120))
    written = size(spark, store.path) - before
    assert few.edges.count() == 200_000 - 21 and written < before / 50
    lots = store.delete(F.col("src") < 2500)
    assert lots.edges.where("src < 2500 or dst between 100 and 120").isEmpty()
    assert size(spark, store.path) - before < before / 3


def scanned(df):
    """Rows that the scans of a plan have put out: those of row groups that statistics did not rule out."""
    df._jdf.collectToPython()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numOutputRows").value()
    return total


def test_row_groups_read_fall_with_the_frontier(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "ROW_GROUP", 32 << 10)
    many = spark.range(120_000).select(F.floor(F.col("id") / 4).alias("src"), (F.col("id") * 7919 % 30_000).alias("dst"))
    version = st.EdgeStore.create(many.coalesce(1), path=str(tmp_path / "s"), bits=4096).snapshot()
    read = {}
    for n in (2, 300, 30_000):
        ids = spark.range(0, n)
        found = version.scan(ids)
        assert found.where(F.col("src") < n).count() == 4 * n
        read[n] = scanned(found)
    assert read[2] < read[300] < read[30_000] == 120_000


def test_coalesced_pages():
    assert st.coalesced([]) == [] and st.coalesced([3]) == [(3, 3)] and st.coalesced([1, 2, 3, 7, 9], 10) == [(1, 3), (7, 7), (9, 9)]
    for _ in range(50):
        pages = sorted(rng.sample(range(1000), 60))
        runs = st.coalesced(pages, 7)
        assert len(runs) <= 7 and all(any(a <= p <= b for a, b in runs) for p in pages) and {a for a, _ in runs} | {b for _, b in runs} <= set(pages)


def test_selective_runs_and_empty_stores(spark, tmp_path):
    g = Graph.dense(frame(spark, EDGES), 200)
    store = st.EdgeStore.create(g.edges, path=str(tmp_path / "s"), per_page=16, bits=256)
    version = store.delete((F.col("src") + F.col("dst")) % 4 == 0)
    live = g.with_edges(g.edges.where("(src + dst) % 4 <> 0"))
    got = version.run(live, traversal.bfs_program(live, EDGES[0][0])).state.select("id", "v.level", "v.parent")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, traversal.bfs(live, EDGES[0][0]).collect()))
    empty = st.EdgeStore.create(frame(spark, []), path=str(tmp_path / "e"))
    assert empty.snapshot().edges.count() == 0 and empty.delete(F.lit(True)).version == 2 and empty.purge().rows == 0
    assert pairs(empty.append(frame(spark, EDGES[:3])).edges) == EDGES[:3]
