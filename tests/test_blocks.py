"""Block-asynchronous fixpoints against plain shortest paths and labels, over small blocks, hubs and long paths."""

import heapq
import random

import numpy as np
import pytest

from tidegraph.graph import Graph
from tidegraph.operators import traversal
from tidegraph.plans import blocks

rng = random.Random(3)
RANDOM = [(rng.randrange(80), rng.randrange(80), float(rng.randint(0, 9))) for _ in range(260)]
HUB = [(7, i, float(i % 5)) for i in range(200)] + [(i, 7, 1.0) for i in range(0, 200, 3)] + [(i, i + 1, 0.5) for i in range(150, 199)]
PATH = [(i, i + 1, 1.0) for i in range(300)]


def graph(spark, edges, n):
    return Graph.dense(spark.createDataFrame(edges, "src long, dst long, weight double"), n)


def plain(edges, source):
    out, heap = {}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in out:
            out[v] = d
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (d + w, b))
    by = {v: min([a for a, b, w in edges if b == v and a in out and out[a] + w == d] + ([source] if v == source else [])) for v, d in out.items()}
    return {v: (d, by[v]) for v, d in out.items()}


@pytest.mark.parametrize("edges, n, source, size", [(RANDOM, 80, 3, 150), (RANDOM, 80, 3, 10_000), (HUB, 200, 7, 60)])
def test_shortest_paths(spark, edges, n, source, size):
    run = traversal.sssp_blocks_run(graph(spark, edges, n), source, size)
    got = {r.id: (r.v, r.tag) for r in run.state.collect()}
    want = plain(edges, source)
    if source == 3:  # the source's own tag may be a vertex at no distance
        got[3] = want[3] = (0.0, 3)
    assert got == want and run.largest <= size


def test_fewer_exchanges_than_supersteps(spark):
    run = traversal.bfs_blocks_run(graph(spark, PATH, 301), 0, 64)
    assert {r.id: r.v for r in run.state.collect()} == {i: i for i in range(301)}
    assert run.blocks >= 6 and run.rounds <= run.blocks + 1 < 300 <= run.steps


@pytest.mark.parametrize("edges, n, size", [(RANDOM, 100, 250), (HUB, 230, 90)])
def test_labels(spark, edges, n, size):
    g = graph(spark, edges, n).symmetrize()
    assert sorted(map(tuple, traversal.cc_blocks(g, size).collect())) == sorted(map(tuple, traversal.cc(g).collect()))


def test_negative_ids_repeated_edges_and_nothing(spark):
    edges = [(-5, -3, 2.0), (-5, -3, 1.0), (-3, -5, 0.0), (-3, 10**15, 4.0)]
    g = Graph(spark.createDataFrame(edges, "src long, dst long, weight double"))
    assert {r.id: r.distance for r in traversal.sssp_blocks(g, -5, 2).collect()} == {-5: 0, -3: 1, 10**15: 5}
    assert traversal.sssp_blocks(g, 77).count() == 0
    empty = Graph(spark.createDataFrame([], "src long, dst long, weight double"), spark.range(3))
    assert sorted(map(tuple, traversal.cc_blocks(empty).collect())) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        traversal.sssp_blocks(Graph(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double")), 1)


def test_no_block_over_its_size_and_every_mirror_is_reached(spark):
    rows, plan = blocks.stored(graph(spark, HUB, 200), 24)
    held = rows.select("block", "n", "ids").collect()
    assert max(r.n for r in held) <= 24 and sum(r.n for r in held) == len(HUB)
    mirrors = {r.block for r in held if 7 in np.frombuffer(r.ids, np.int64)}
    at, to = plan.of_values(np.array([7, 8]))
    assert len(mirrors) > 5 and mirrors <= {int(b) for i, b in zip(at, to) if i == 0} and sum(at == 1) == 1


def test_many_rounds_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LOG", 2)
    back = [(i + 1, i, 1.0) for i in range(20)] + [(i, (i * 7) % 21, 50.0) for i in range(21)]
    got = {r.id: (r.distance, r.predecessor) for r in traversal.sssp_blocks(graph(spark, back, 21), 20, 12).collect()}
    assert got == plain(back, 20)


def test_edges_are_made_once(spark, tmp_path):
    def told(batches):
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    edges = spark.createDataFrame(RANDOM, "src long, dst long, weight double").coalesce(1).mapInArrow(told, "src long, dst long, weight double")
    state = traversal.bfs_blocks(Graph(edges, spark.range(80)), 3, 150)
    want = {v: int(d) for v, (d, _) in plain([(a, b, 1.0) for a, b, _ in RANDOM], 3).items()}
    assert {r.id: r.level for r in state.collect()} == want and len(list(tmp_path.iterdir())) == 1


def test_symmetric_graphs_say_so_without_weights(spark):
    g = graph(spark, RANDOM, 80).symmetrize()
    assert g.unweighted().symmetric and not graph(spark, RANDOM, 80).unweighted().symmetric
    rows, _ = blocks.stored(g.unweighted(), 150)
    assert all(np.frombuffer(r.live, np.uint8).all() for r in rows.collect())
