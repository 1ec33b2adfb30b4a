"""Strongly connected components: small weak components in a task each, large ones by colouring forward and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.components import by_component
from ..plans.lineage import counted, cut, drop
from ..plans.superstep import MonotoneProgram, run_monotone

#: Rounds of peeling ends off before each colouring.
PEELS = 3


def _strong(ids: np.ndarray, begin: list[int], to: list[int], _) -> list[np.ndarray]:
    """Tarjan's stack, without recursion: the least id of each strong component."""
    n, count = len(ids), 0
    seen, low, component, at, stack = [0] * n, [0] * n, [-1] * n, begin[:n], []
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            u = path[-1]
            if not seen[u]:
                count += 1
                seen[u] = low[u] = count
                stack.append(u)
            if at[u] < begin[u + 1]:
                v = to[at[u]]
                at[u] += 1
                if not seen[v]:
                    path.append(v)
                elif component[v] < 0:
                    low[u] = min(low[u], seen[v])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[u])
            if low[u] == seen[u]:
                k = len(stack) - 1
                while stack[k] != u:
                    k -= 1
                least = min(stack[k:])
                for v in stack[k:]:
                    component[v] = least
                del stack[k:]
    return [ids[component]]


def scc(graph: Graph, size: int | None = None) -> DataFrame:
    """id, component: the least id of a vertex's strong component. Weak components of over ``size`` edges are coloured."""
    return by_component(graph.unweighted(), _strong, "id long, component long", lambda large: coloured(large, size), {"component": F.col("id")}, size)


def coloured(graph: Graph, size: int | None = None) -> DataFrame:
    """As ``scc``, by colouring forward and back over all edges.

    Vertices without edges in or out among what is left are components of their own and are peeled off.
    A colour is the least id that reaches a vertex; what reaches that id back within its colour is its
    component. Edges between colours, and those of finished vertices, go. What then is left lies in smaller weak
    components.
    """
    edges, left = counted(graph.edges.where("src <> dst").select("src", "dst").distinct())
    for _ in range(PEELS if left else 0):
        inner = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        inner = cut(inner)
        s, d = inner.withColumnRenamed("id", "src"), inner.withColumnRenamed("id", "dst")
        before = edges
        edges, now = counted(edges.join(s, "src", "left_semi").join(d, "dst", "left_semi").select("src", "dst"))
        drop(before, inner)
        done, left = now == left, now
        if done or not left:
            break
    if not left:
        return graph.vertices.select("id", F.col("id").alias("component"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    part = Graph(edges, ends)
    colours = cut(run_monotone(part, MonotoneProgram(ends.select("id", F.col("id").alias("v")), lambda: F.col("v"))).state)
    s, d = (colours.select(F.col("id").alias(x), F.col("v").alias(f"c{x}")) for x in ("src", "dst"))
    same = cut(edges.join(s, "src").join(d, "dst").where("csrc = cdst").select("src", "dst", F.col("csrc").alias("c")))
    roots = colours.where("id = v").select("id", "v")
    back = Graph(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends)
    core = cut(run_monotone(back, MonotoneProgram(roots, lambda: F.col("v"), first_only=True)).state)
    s, d = core.select(F.col("id").alias("src")), core.select(F.col("id").alias("dst"))
    before = edges
    edges, left = counted(same.select("src", "dst").join(s, "src", "left_anti").join(d, "dst", "left_anti").select("src", "dst"))
    drop(before, same, colours)
    labels = core
    if left:
        rest = scc(Graph(edges), size).where("id <> component").select("id", F.col("component").alias("v"))
        labels = core.unionByName(rest)
    vertices = graph.vertices
    return vertices.join(labels, "id", "left").select("id", F.coalesce("v", "id").alias("component"))
