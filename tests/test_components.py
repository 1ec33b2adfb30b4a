"""Weak components by contraction, and whole components in a task against supersteps over all edges."""

import random

import pytest

from tidegraph.graph import Graph
from tidegraph.operators import strong, traversal
from tidegraph.plans import components, superstep


def rows(df):
    return sorted(map(tuple, df.collect()))


def graph(spark, edges, n):
    return Graph(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"), spark.range(n))


def some(seed, n, m):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(4)) for _ in range(m)]


CASES = {
    "sparse": (some(1, 60, 55), 60),
    "dense": (some(2, 40, 120), 40),
    "pieces": ([(a + 20 * k, b + 20 * k, w) for k in range(4) for a, b, w in some(k, 18, 30)], 85),
    "loops": ([(3, 3, 0), (5, 5, 1), (5, 6, 0), (6, 5, 0), (6, 6, 0), (5, 6, 2)], 9),
    "none": ([], 5),
}


@pytest.mark.parametrize("name", CASES)
def test_whole_components_and_supersteps_agree(spark, name):
    edges, n = CASES[name]
    g = graph(spark, edges, n)
    for size in (0, 35, None):  # all by supersteps, some, none
        assert rows(traversal.bfs_forest(g, size)) == rows(traversal.bfs_forest_supersteps(g.unweighted()))
        assert rows(traversal.sssp_forest(g, size)) == rows(traversal.sssp_forest_supersteps(g))
    least = {v: v for v in range(n)}
    reach = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b, _w in edges:
            reach[a] |= reach[b]
    expected = sorted((v, min(u for u in reach[v] if v in reach[u])) for v in least)
    for size in (0, 35, None):
        assert rows(strong.scc(g, size)) == expected


def test_few_rounds_on_long_paths(spark, monkeypatch):
    """A path in the order of its ids takes as many supersteps as it is long; contraction a few rounds."""
    n, made = 400, []
    g = Graph(spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n + 2, n + 1), (n + 5, n + 5)], "src long, dst long"), spark.range(n + 6)).symmetrize()
    monkeypatch.setattr(components, "counted", lambda *a: made.append(1) or superstep.counted(*a))
    expected = sorted((i, 0 if i < n else n + 1 if i == n + 2 else i) for i in range(n + 6))
    assert rows(traversal.cc(g)) == expected
    assert 0 < len(made) <= 25


def test_labels_of_negative_and_large_ids(spark):
    edges = [(-5, 2**62), (2**62, -(2**62)), (7, 8), (-1, -1)]
    found = components.weak(spark.createDataFrame(edges, "src long, dst long"))
    assert rows(found) == sorted([(-5, -(2**62)), (2**62, -(2**62)), (-(2**62), -(2**62)), (7, 7), (8, 7), (-1, -1)])
