"""The registered graph queries, and what any SQL engine says to the same question.

Every computed double is rounded, ties are settled by the least id, and vertices that are not reached
have no row, so both sides agree row for row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures
from .fixtures import COPURCHASE_SQL, EVENT_EDGES_SQL, PART_EDGES_SQL, RATINGS_SQL, SYMMETRIC_SQL, WHOLE_COPURCHASE_SQL
from .graph import Graph
from .operators import belief, centrality, factorisation, independent, mutation, neighbourhoods, pageindex, ranking, scans, sorting, spanning, store, strong, traversal, triangles
from .plans.lineage import cut, union, work_path
from .plans.superstep import BatchProgram, VertexProgram, run, run_batches, run_monotone
from .sources import edgefiles, generators
from .streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Added before rounding, so that decimal halves go up whatever the last bit says.
NUDGE = 1e-10


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) for c in columns})


def root_of(graph: Graph) -> int:
    """The least source."""
    return graph.edges.agg(F.min("src")).first()[0]


def symmetric(spark: SparkSession, sf_dir: str) -> Graph:
    return fixtures.part_edges(spark, sf_dir).symmetrize()


PART, SYM, COP, RAT = (f"WITH RECURSIVE {x}" for x in (PART_EDGES_SQL, SYMMETRIC_SQL, COPURCHASE_SQL, RATINGS_SQL))
#: Levels of a breadth-first search: each round looks at vertices that no round before has seen.
BFS_SQL = """,
    b(id, level, parent) USING KEY (id) AS (
        SELECT min(src), CAST(0 AS INTEGER), min(src) FROM e
        UNION
        SELECT e.dst, min(b.level) + 1, min(b.id) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst)"""


def unrolled(name: str, first: str, step: Callable[[int], str], rounds: int) -> str:
    """CTEs name0 .. nameN, each from the one before."""
    return f",\n    {name}0 AS MATERIALIZED ({first})" + "".join(f",\n    {name}{k} AS MATERIALIZED ({step(k)})" for k in range(1, rounds + 1))


# scans -----------------------------------------------------------------------------------------------


@query(PART + " SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def degree_cnt(spark, sf_dir):
    return scans.degree_cnt(fixtures.part_edges(spark, sf_dir))


@query(PART + ", d AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT degree, count(*) AS n_vertices FROM d GROUP BY degree")
def degree_hist(spark, sf_dir):
    return scans.degree_hist(fixtures.part_edges(spark, sf_dir))


@query(
    PART + """, t AS (SELECT count(*) FILTER (src % 2 <> dst % 2) AS crossing, count(*) FILTER (src % 2 <> 0) AS from_red, count(*) FILTER (src % 2 = 0) AS from_black FROM e)
    SELECT crossing, from_red, from_black, round(crossing / CAST(greatest(from_red, from_black) AS DOUBLE) + 1e-10, 6) AS conductance FROM t"""
)
def conductance(spark, sf_dir):
    return rounded(scans.conductance(fixtures.part_edges(spark, sf_dir)), "conductance")


@query(PART + ", m AS (SELECT max(p_partkey) AS most FROM part) SELECT src, dst FROM e, m WHERE greatest(src, dst) > most - 10")
def range_check(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return scans.range_check(graph, graph.vertices.agg(F.max("id")).first()[0] - 10).select("src", "dst")


@query(PART + " SELECT dst AS src, src AS dst, weight FROM e")
def reverse(spark, sf_dir):
    return scans.reverse(fixtures.part_edges(spark, sf_dir))


@query(PART + " SELECT v.id, round(coalesce(sum(e.weight * e.src), 0.0) + 1e-10, 6) AS y FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def spmv(spark, sf_dir):
    return rounded(scans.spmv(fixtures.part_edges(spark, sf_dir)), "y")


BIP = """, n2 AS (SELECT src AS id, dst AS other FROM {0} UNION ALL SELECT dst, src FROM {0}),
    f AS (SELECT id, (bool_or(other > id) AND bool_or(other < id)) OR bool_or(other = id) AS bad FROM n2 GROUP BY id)
    SELECT bool_or(bad) AS not_bipartite, count(*) FILTER (bad) AS n_conflicts FROM f"""


@query(PART + BIP.format("e"))
def checkbip(spark, sf_dir):
    return scans.checkbip(fixtures.part_edges(spark, sf_dir))


@query(RAT + BIP.format("r"))
def checkbip_ratings(spark, sf_dir):
    return scans.checkbip(fixtures.ratings(spark, sf_dir))  # each edge is looked at from both of its ends


# traversals ------------------------------------------------------------------------------------------


@query(PART + BFS_SQL + " SELECT id, level, parent FROM b")
def bfs(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return traversal.bfs(graph, root_of(graph))


@query(PART + BFS_SQL + " SELECT id FROM b")
def bfs_async(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return traversal.bfs_async(graph, root_of(graph))


@query(PART + BFS_SQL + " SELECT count(DISTINCT b.id) AS vertices_discovered, count(e.src) AS edges_explored FROM b LEFT JOIN e ON e.src = b.id")
def bfs_metrics(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return traversal.bfs_metrics(graph, root_of(graph))


#: Values that fall to their fixpoint; rows are compared as (component, distance).
FOREST_SQL = """,
    f(id, component, distance) USING KEY (id) AS (
        SELECT id, id, {zero} FROM v
        UNION
        SELECT n.id, n.m.c, n.m.d FROM (
            SELECT e.dst AS id, min({{'c': f.component, 'd': f.distance + {w}}}) AS m FROM f JOIN e ON e.src = f.id GROUP BY e.dst) n
        JOIN recurring.f r ON r.id = n.id
        WHERE n.m.c < r.component OR n.m.c = r.component AND n.m.d < r.distance)
    SELECT f.id, f.component, f.distance AS {name}, coalesce(min(g.id), f.id) AS {parent}
    FROM f LEFT JOIN e ON e.dst = f.id LEFT JOIN f g ON g.id = e.src AND g.component = f.component AND g.distance + {w} = f.distance AND f.id <> f.component
    GROUP BY f.id, f.component, f.distance"""


@query(PART + FOREST_SQL.format(zero="CAST(0 AS INTEGER)", w="CAST(1 AS INTEGER)", name="level", parent="parent"))
def bfs_forest(spark, sf_dir):
    return traversal.bfs_forest(fixtures.part_edges(spark, sf_dir))


@query(PART + FOREST_SQL.format(zero="CAST(0 AS DOUBLE)", w="e.weight", name="distance", parent="predecessor"))
def sssp_forest(spark, sf_dir):
    return traversal.sssp_forest(fixtures.part_edges(spark, sf_dir))


SSSP_SQL = """,
    p(id, distance) USING KEY (id) AS (
        SELECT min(src), CAST(0 AS DOUBLE) FROM e
        UNION
        SELECT n.id, n.d FROM (SELECT e.dst AS id, min(p.distance + e.weight) AS d FROM p JOIN e ON e.src = p.id GROUP BY e.dst) n
        LEFT JOIN recurring.p r ON r.id = n.id WHERE r.id IS NULL OR n.d < r.distance)"""


@query(
    PART + SSSP_SQL + """
    SELECT p.id, p.distance, coalesce(min(q.id), p.id) AS predecessor
    FROM p LEFT JOIN e ON e.dst = p.id LEFT JOIN p q ON q.id = e.src AND q.distance + e.weight = p.distance AND p.distance > 0
    GROUP BY p.id, p.distance"""
)
def sssp(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return traversal.sssp(graph, root_of(graph))


LABELS_SQL = """,
    l(id, c) USING KEY (id) AS (
        SELECT id, id FROM v
        UNION
        SELECT n.id, n.c FROM (SELECT x.dst AS id, min(l.c) AS c FROM l JOIN {x} x ON x.src = l.id GROUP BY x.dst) n JOIN recurring.l r ON r.id = n.id WHERE n.c < r.c)"""


TWO_COLOURS = FOREST_SQL.format(zero="CAST(0 AS INTEGER)", w="CAST(1 AS INTEGER)", name="level", parent="parent").partition("    SELECT f.id")[0].rstrip().replace("JOIN e ON", "JOIN s e ON") + """,
    o AS (SELECT a.component, min({'a': s.src, 'b': s.dst}) AS odd FROM s JOIN f a ON a.id = s.src JOIN f b ON b.id = s.dst WHERE a.distance % 2 = b.distance % 2 GROUP BY a.component)
    SELECT f.id, f.component, CASE WHEN o.odd IS NULL THEN f.distance % 2 END AS colour, o.odd IS NULL AS bipartite, o.odd.a AS odd_src, o.odd.b AS odd_dst FROM f LEFT JOIN o ON o.component = f.component"""


@query(SYM + TWO_COLOURS)
def two_colours(spark, sf_dir):
    return scans.two_colours(fixtures.part_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {RATINGS_SQL}, s AS (SELECT src, dst FROM r UNION ALL SELECT dst, src FROM r), v AS (SELECT DISTINCT src AS id FROM s)" + TWO_COLOURS)
def two_colours_ratings(spark, sf_dir):
    return scans.two_colours(fixtures.ratings(spark, sf_dir))


@query(SYM + LABELS_SQL.format(x="s") + " SELECT id, c AS component FROM l")
def cc(spark, sf_dir):
    return traversal.cc(symmetric(spark, sf_dir))


@query(SYM + LABELS_SQL.format(x="s") + " SELECT count(*) AS cc_count FROM l WHERE id = c")
def cc_count(spark, sf_dir):
    return traversal.cc_count(traversal.cc(symmetric(spark, sf_dir)))


@query(ORACLE_SQL["bfs"])
def bfs_blocks(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return traversal.bfs_blocks(graph, root_of(graph))


@query(ORACLE_SQL["sssp"])
def sssp_blocks(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return traversal.sssp_blocks(graph, root_of(graph))


@query(ORACLE_SQL["cc"])
def cc_blocks(spark, sf_dir):
    return traversal.cc_blocks(symmetric(spark, sf_dir))


REACH_SQL = """,
    reach(a, b) AS (SELECT src, dst FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON e.src = reach.b)
    SELECT v.id, least(v.id, coalesce(min(m.b), v.id)) AS component
    FROM v LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) m ON m.a = v.id GROUP BY v.id"""


@query(PART + REACH_SQL)
def scc(spark, sf_dir):
    return strong.scc(fixtures.part_edges(spark, sf_dir))


# whole-state programs --------------------------------------------------------------------------------

MIS_ROUNDS = 24


@query(
    COP + unrolled("m", "SELECT id, true AS i FROM v", lambda k: f"SELECT v.id, NOT EXISTS (SELECT 1 FROM c JOIN m{k - 1} p ON p.id = c.src WHERE c.dst = v.id AND c.src < c.dst AND p.i) AS i FROM v", MIS_ROUNDS)
    + f" SELECT id, i AS in_mis FROM m{MIS_ROUNDS}"
)
def mis(spark, sf_dir):
    return independent.mis(fixtures.copurchase(spark, sf_dir))


RANK_STEP = "SELECT v.id, 0.15 + 0.85 * coalesce(g.s, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, sum(r.rank / d.deg) AS s FROM e JOIN r{0} r ON r.id = e.src JOIN d ON d.src = e.src GROUP BY e.dst) g ON g.dst = v.id"


@query(
    PART + ", d AS (SELECT src, count(*) AS deg FROM e GROUP BY src)" + unrolled("r", "SELECT id, CAST(1 AS DOUBLE) AS rank FROM v", lambda k: RANK_STEP.format(k - 1), 5)
    + " SELECT id, round(rank + 1e-10, 6) AS rank FROM r5"
)
def pagerank(spark, sf_dir):
    return rounded(ranking.pagerank(fixtures.part_edges(spark, sf_dir), rounds=5), "rank")


DELTA_ROUNDS = 20
DELTA_STEP = """
    SELECT p.id, p.deg, p.rank + CASE WHEN p.deg > 0 AND p.delta / greatest(p.deg, 1) > 0.5 THEN p.delta ELSE 0 END AS rank,
        CASE WHEN p.deg > 0 AND p.delta / greatest(p.deg, 1) > 0.5 THEN 0 ELSE p.delta END + 0.85 * coalesce(g.s, 0) AS delta
    FROM r{0} p LEFT JOIN (SELECT e.dst, sum(q.delta / q.deg) AS s FROM e JOIN r{0} q ON q.id = e.src WHERE q.delta / q.deg > 0.5 GROUP BY e.dst) g ON g.dst = p.id"""


@query(
    PART + unrolled("r", "SELECT v.id, count(e.src) AS deg, CAST(0.15 AS DOUBLE) AS rank, CAST(1 AS DOUBLE) AS delta FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id", lambda k: DELTA_STEP.format(k - 1), DELTA_ROUNDS)
    + f" SELECT id, round(rank + 1e-10, 6) AS rank, round(delta + 1e-10, 6) AS delta FROM r{DELTA_ROUNDS}"
)
def pagerank_delta(spark, sf_dir):
    return rounded(ranking.pagerank_delta(fixtures.part_edges(spark, sf_dir), rounds=DELTA_ROUNDS), "rank", "delta")


BP_ROUNDS = 4
WAYS = "SELECT src AS a, dst AS b, weight FROM e UNION ALL SELECT dst, src, weight FROM e"


def _bp_sql(edges: str, wanted: str) -> str:
    sql = PART + f", w AS (SELECT src AS a, dst AS b, w FROM ({edges}) UNION ALL SELECT dst, src, w FROM ({edges})), m0 AS (SELECT a, b, w, w AS m0, w AS m1 FROM w)"
    for k in range(BP_ROUNDS):
        sql += f""", p{k} AS MATERIALIZED (SELECT b AS id, sum(ln(m0)) AS l0, sum(ln(m1)) AS l1 FROM m{k} GROUP BY b),
        t{k} AS (SELECT m.b AS a, m.a AS b, m.w, l0 - ln(m0) AS t0, l1 - ln(m1) AS t1 FROM m{k} m JOIN p{k} p ON p.id = m.b),
        u{k} AS (SELECT a, b, w, ln(0.5 * CASE WHEN a < b THEN w ELSE 1 - w END) + greatest(t0, t1) + ln(exp(t0 - greatest(t0, t1)) + exp(t1 - greatest(t0, t1))) AS g FROM t{k}),
        m{k + 1} AS MATERIALIZED (SELECT a, b, w, exp(g - g) / (exp(g - g) + exp(g - g)) AS m0, exp(g - g) / (exp(g - g) + exp(g - g)) AS m1 FROM u{k})"""
    return sql + wanted.format(p=f"p{BP_ROUNDS - 1}")


@query(_bp_sql("SELECT src, dst, weight / 10 AS w FROM e", " SELECT v.id, round(exp(coalesce(l0, 0.0)) + 1e-10, 9) AS product0, round(exp(coalesce(l1, 0.0)) + 1e-10, 9) AS product1 FROM v LEFT JOIN {p} p ON p.id = v.id"))
def bp(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    graph = graph.with_edges(graph.edges.withColumn("weight", F.col("weight") / 10))
    return rounded(belief.belief_propagation(graph, BP_ROUNDS).select("id", "product0", "product1"), "product0", "product1", digits=9)


@query(
    _bp_sql(
        "SELECT src, dst, weight / 10 AS w FROM e UNION ALL SELECT CAST(-1 AS BIGINT), id, 0.5 FROM v",
        " SELECT x.id, round(coalesce(l0, 0.0) + 1e-10, 6) AS log_product0, round(coalesce(l1, 0.0) + 1e-10, 6) AS log_product1 FROM (SELECT id FROM v UNION ALL SELECT CAST(-1 AS BIGINT)) x LEFT JOIN {p} p ON p.id = x.id",
    )
)
def bp_hub(spark, sf_dir):
    """A vertex beside all parts: its product is far below what a double holds, its messages are not."""
    graph = fixtures.part_edges(spark, sf_dir)
    spokes = graph.vertices.select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(0.5).alias("weight"))
    hubbed = Graph(graph.edges.withColumn("weight", F.col("weight") / 10).unionByName(spokes), graph.vertices.unionByName(spark.range(-1, 0)))
    return rounded(belief.belief_propagation(hubbed, BP_ROUNDS).select("id", "log_product0", "log_product1"), "log_product0", "log_product1")


PRIOR = "CASE WHEN ((17 + {0}) * 3428971) % 100 = 1 THEN 0.95 WHEN ((17 + {0}) * 3428971) % 100 = 0 THEN 0.05 ELSE 0.5 END"


def _seeded_sql() -> str:
    sql = PART + f", w AS ({WAYS}), m0 AS (SELECT a, b, CAST({PRIOR.format('a')} AS DOUBLE) AS m FROM w)"
    for k in range(BP_ROUNDS):
        sql += f""", l{k} AS MATERIALIZED (
            SELECT v.id, CAST({PRIOR.format('v.id')} AS DOUBLE) AS p, coalesce(sum(ln(m)), 0) AS l0, coalesce(sum(ln(1 - m)), 0) AS l1 FROM v LEFT JOIN m{k} m ON m.b = v.id GROUP BY v.id),
        h{k} AS (SELECT id, p, greatest(1e-4, p * exp(l0 - greatest(l0, l1))) AS b0, greatest(1e-4, (1 - p) * exp(l1 - greatest(l0, l1))) AS b1 FROM l{k}),
        s{k} AS MATERIALIZED (SELECT id, CASE WHEN ((17 + id) * 3428971) % 100 <= 1 THEN p ELSE b0 / (b0 + b1) END AS x FROM h{k}),
        t{k} AS (SELECT m.b AS a, m.a AS b, x * 0.95 / m + (1 - x) * 0.5 / (1 - m) AS t0, x * 0.05 / m + (1 - x) * 0.5 / (1 - m) AS t1 FROM m{k} m JOIN s{k} s ON s.id = m.b),
        m{k + 1} AS MATERIALIZED (SELECT a, b, greatest(1e-4, least(0.9999, t0 / (t0 + t1))) AS m FROM t{k})"""
    return sql + f" SELECT id, round(x + 1e-10, 6) AS belief0, round(1 - x + 1e-10, 6) AS belief1 FROM s{BP_ROUNDS - 1}"


@query(_seeded_sql())
def bp_seeded(spark, sf_dir):
    return rounded(belief.belief_propagation_seeded(fixtures.part_edges(spark, sf_dir), BP_ROUNDS), "belief0", "belief1")


# forests, centrality, factors ------------------------------------------------------------------------


#: Components when only edges up to each weight count (weights are whole numbers from 1 to 8): where they fall, edges of that weight are taken.
FOREST_WEIGHT_SQL = """,
    w AS (SELECT CAST(range AS INTEGER) AS k FROM range(9)),
    l(k, id, c) USING KEY (k, id) AS (
        SELECT k, id, id FROM w, v
        UNION
        SELECT n.k, n.id, n.c FROM (SELECT l.k, x.dst AS id, min(l.c) AS c FROM l JOIN s x ON x.src = l.id AND x.weight <= l.k GROUP BY l.k, x.dst) n JOIN recurring.l r ON r.k = n.k AND r.id = n.id WHERE n.c < r.c),
    m AS (SELECT k, count(*) AS n FROM l WHERE id = c GROUP BY k)
    SELECT (SELECT count(*) FROM v) - (SELECT n FROM m WHERE k = 8) AS tree_edges, (SELECT n FROM m WHERE k = 8) AS cc_count, CAST(sum(a.k * (b.n - a.n)) AS DOUBLE) AS total_weight FROM m a JOIN m b ON b.k = a.k - 1"""


@query(SYM + FOREST_WEIGHT_SQL)
def mcst_summary(spark, sf_dir):
    return spanning.mcst_summary(fixtures.part_edges(spark, sf_dir))


#: Edges one after the other in their order, each taken if its ends have different labels then. Row -1 holds the place, rows below the edges taken.
KRUSKAL_SQL = """,
    o AS MATERIALIZED (SELECT u, v, weight, row_number() OVER (ORDER BY weight, u, v) AS k FROM (SELECT src AS u, dst AS v, weight FROM s WHERE src < dst)),
    t(id, c) USING KEY (id) AS (
        SELECT id, id FROM v UNION ALL SELECT -1, 0
        UNION
        SELECT n.id, n.c FROM (
            SELECT CASE j.i WHEN 0 THEN -1 WHEN 1 THEN -1 - o.k ELSE r.id END AS id, CASE j.i WHEN 0 THEN o.k WHEN 1 THEN o.k ELSE least(a.c, b.c) END AS c
            FROM t JOIN o ON o.k = t.c + 1 JOIN recurring.t a ON a.id = o.u JOIN recurring.t b ON b.id = o.v, (VALUES (0), (1), (2)) j(i), recurring.t r
            WHERE t.id = -1 AND (j.i = 0 AND r.id = -1 OR a.c <> b.c AND (j.i = 1 AND r.id = -1 OR j.i = 2 AND r.id >= 0 AND r.c = greatest(a.c, b.c)))) n)
    SELECT o.u AS src, o.v AS dst, o.weight FROM t JOIN o ON o.k = -1 - t.id WHERE t.id < -1"""


@query(SYM + KRUSKAL_SQL)
def mcst(spark, sf_dir):
    return spanning.mcst(fixtures.part_edges(spark, sf_dir))


def _bc_sql() -> str:
    """Paths forward level by level, then shares back, over the levels of the breadth-first search."""
    return PART + BFS_SQL + """,
    g AS MATERIALIZED (SELECT e.src, e.dst, x.level FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst WHERE y.level = x.level + 1),
    top AS (SELECT max(level) AS most FROM b),
    s(id, level, x) AS (
        SELECT id, level, CAST(1 AS DOUBLE) FROM b WHERE level = 0
        UNION ALL
        SELECT g.dst, g.level + 1, sum(s.x) FROM s JOIN g ON g.src = s.id AND g.level = s.level GROUP BY g.dst, g.level),
    back(id, level, x) USING KEY (id) AS (
        SELECT id, level, CAST(0 AS DOUBLE) FROM b, top WHERE level = most
        UNION
        SELECT b2.id, b2.level, coalesce(sum(p.x / q.x * (1 + k.x)), 0)
        FROM (SELECT DISTINCT level - 1 AS level FROM back) l1 JOIN b b2 ON b2.level = l1.level
        LEFT JOIN g ON g.src = b2.id LEFT JOIN s p ON p.id = g.src LEFT JOIN s q ON q.id = g.dst LEFT JOIN back k ON k.id = g.dst
        GROUP BY b2.id, b2.level)
    SELECT s.id, round(s.x + 1e-10, 6) AS paths, round(back.x + 1e-10, 6) AS centrality FROM s JOIN back ON back.id = s.id"""


@query(_bc_sql())
def bc(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return rounded(centrality.betweenness(graph.unweighted(), root_of(graph)), "paths", "centrality")


#: Shortest paths by their number of edges, forward, and shares back in the same way: both sums end with the longest path.
WEIGHTED_BC_SQL = SSSP_SQL + """,
    g AS MATERIALIZED (SELECT e.src, e.dst FROM e JOIN p x ON x.id = e.src JOIN p y ON y.id = e.dst WHERE x.distance + e.weight = y.distance AND e.src <> e.dst),
    hops(id, h, x) AS (SELECT min(src), 0, CAST(1 AS DOUBLE) FROM e UNION ALL SELECT g.dst, hops.h + 1, sum(hops.x) FROM hops JOIN g ON g.src = hops.id GROUP BY g.dst, hops.h),
    n AS MATERIALIZED (SELECT id, sum(x) AS x FROM hops GROUP BY id),
    r AS MATERIALIZED (SELECT g.src, g.dst, a.x / b.x AS share FROM g JOIN n a ON a.id = g.src JOIN n b ON b.id = g.dst),
    back(id, h, x) AS (SELECT id, 0, CAST(1 AS DOUBLE) FROM n UNION ALL SELECT r.src, back.h + 1, sum(r.share * back.x) FROM back JOIN r ON r.dst = back.id GROUP BY r.src, back.h),
    q AS (SELECT id, sum(x) AS x FROM back WHERE h > 0 GROUP BY id)
    SELECT n.id, round(n.x + 1e-10, 6) AS paths, round(coalesce(q.x, 0) + 1e-10, 6) AS centrality FROM n LEFT JOIN q ON q.id = n.id"""


@query(PART + WEIGHTED_BC_SQL)
def bc_weighted(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return rounded(centrality.betweenness(graph, root_of(graph)), "paths", "centrality")


ALS_ROUNDS, PENALTY = 2, 0.065


def _als_sql() -> str:
    """Factors of two numbers: the normal equations of two unknowns have a formula."""
    first = lambda k: f"0.5::DOUBLE + ((id + 1) * {k * 7919 + 1} % 104729) / 209458::DOUBLE"
    sql = RAT + f", z AS (SELECT src AS a, dst AS b, CAST(weight AS DOUBLE) AS x FROM r), l0 AS MATERIALIZED (SELECT id, {first(0)} AS f, {first(1)} AS g FROM (SELECT DISTINCT a AS id FROM z))"
    solved = lambda own, other, table: f"""SELECT id, (q * t - s * u) / (p * q - s * s) AS f, (p * u - s * t) / (p * q - s * s) AS g FROM (
        SELECT z.{own} AS id, sum(f * f) + {PENALTY} * count(*) AS p, sum(g * g) + {PENALTY} * count(*) AS q, sum(f * g) AS s, sum(f * x) AS t, sum(g * x) AS u FROM z JOIN {table} y ON y.id = z.{other} GROUP BY z.{own})"""  # noqa: E731
    for k in range(ALS_ROUNDS):
        sql += f", h{k} AS MATERIALIZED ({solved('b', 'a', f'l{k}')}), l{k + 1} AS MATERIALIZED ({solved('a', 'b', f'h{k}')})"
    return sql


@query(_als_sql() + f" SELECT count(*) AS edges, round(sum((x - l.f * h.f - l.g * h.g) ** 2) + 1e-10, 3) AS sse, round(sqrt(sum((x - l.f * h.f - l.g * h.g) ** 2) / count(*)) + 1e-10, 6) AS rmse FROM z JOIN l{ALS_ROUNDS} l ON l.id = z.a JOIN h{ALS_ROUNDS - 1} h ON h.id = z.b")
def als(spark, sf_dir):
    fit = factorisation.als(fixtures.ratings(spark, sf_dir), rank=2, rounds=ALS_ROUNDS, penalty=PENALTY)[2]
    return rounded(rounded(fit, "sse", digits=3), "rmse")


@query(_als_sql() + f" SELECT id, round(f + 1e-10, 6) AS f0, round(g + 1e-10, 6) AS f1 FROM l{ALS_ROUNDS} UNION ALL SELECT id, round(f + 1e-10, 6), round(g + 1e-10, 6) FROM h{ALS_ROUNDS - 1}")
def als_async(spark, sf_dir):
    return rounded(factorisation.als_async(fixtures.ratings(spark, sf_dir), rank=2, rounds=ALS_ROUNDS, penalty=PENALTY), "f0", "f1")


# neighbourhoods and triangles ------------------------------------------------------------------------


@query(
    PART + unrolled("h", "SELECT id, id AS u FROM v", lambda k: f"SELECT id, u FROM h{k - 1} UNION SELECT e.dst, h.u FROM h{k - 1} h JOIN e ON e.src = h.id", 4)
    + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS t, count(*) AS pairs FROM h{k}" for k in range(5)) + ")"
)
def hyperanf_exact(spark, sf_dir):
    return neighbourhoods.hyperanf_exact(fixtures.part_edges(spark, sf_dir), 4)


HLL_FIRST = """SELECT id, CAST(h & 127 AS INTEGER) AS register, CAST(CASE WHEN h >> 7 = 0 THEN 26 ELSE round(log2((h >> 7) & -(h >> 7))) + 1 END AS INTEGER) AS value
    FROM (SELECT id, ((id * 31 + 8) * 2246822519) & 4294967295 AS h FROM v)"""


@query(
    PART + unrolled("h", HLL_FIRST, lambda k: f"SELECT id, register, max(value) AS value FROM (SELECT * FROM h{k - 1} UNION ALL SELECT e.dst, h.register, h.value FROM h{k - 1} h JOIN e ON e.src = h.id) GROUP BY id, register", 3)
    + " SELECT id, register, value FROM h3"
)
def hyperanf_hll(spark, sf_dir):
    return neighbourhoods.hll_registers(fixtures.part_edges(spark, sf_dir), 3)


#: Steps until one, which is told of too, changes no register.
HYPERANF_SQL = f"""WITH RECURSIVE {WHOLE_COPURCHASE_SQL},
    h AS (
        SELECT CAST(0 AS INTEGER) AS t, id, register, value, true AS grew FROM ({HLL_FIRST})
        UNION ALL
        SELECT t + 1, id, register, value, bool_or(up) OVER () FROM (
            SELECT max(t) AS t, id, register, max(value) AS value, max(value) > coalesce(max(own), 0) AS up FROM (
                SELECT t, id, register, value, value AS own FROM h WHERE grew
                UNION ALL SELECT h.t, c.dst, h.register, h.value, NULL FROM h JOIN c ON c.src = h.id WHERE h.grew) GROUP BY id, register)),
    s AS (SELECT t, id, 128 - count(*) AS empty, 0.7213 / (1 + 1.079 / 128) * 128 * 128 / (sum(pow(2, -value)) + 128 - count(*)) AS raw FROM h GROUP BY t, id),
    r AS (SELECT t, id, round(CASE WHEN raw <= 320 AND empty > 0 THEN 128 * ln(128 / empty) ELSE raw END, 9) AS reach FROM s)
    SELECT t, round(sum(reach) + 1e-10, 3) AS estimate, -max({{'a': reach, 'b': -id}}).b AS seed, round(max(reach) + 1e-10, 3) AS seed_reach FROM r GROUP BY t"""


@query(HYPERANF_SQL)
def hyperanf(spark, sf_dir):
    told = neighbourhoods.hyperanf_of_groups(fixtures.order_members(spark, sf_dir), fixtures.parts(spark, sf_dir), max_steps=None, to_the_end=True)
    return rounded(told, "estimate", "seed_reach", digits=3)


@query(
    COP + """, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM c a JOIN c b ON b.src = a.dst JOIN c d ON d.src = a.src AND d.dst = b.dst WHERE a.src < a.dst AND a.dst < b.dst)
    SELECT v.id, count(u.id) AS triangles FROM v LEFT JOIN (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) u ON u.id = v.id GROUP BY v.id"""
)
def triangles_exact(spark, sf_dir):
    return triangles.triangles_exact(fixtures.copurchase(spark, sf_dir))


TRIANGLE_ROUNDS = 16


@query(
    COP + f""", k AS (SELECT k, (1103515245 * (k + 1)) % 2147483647 AS a, (12345 + 2246822519 * k) % 2147483647 AS b FROM (SELECT CAST(range AS BIGINT) AS k FROM range({TRIANGLE_ROUNDS}))),
    h AS MATERIALIZED (SELECT c.src AS id, k.k, min((c.dst * k.a + k.b) % 2147483647) AS m FROM c, k GROUP BY c.src, k.k),
    d AS (SELECT src AS id, count(*) AS deg FROM c GROUP BY src),
    z AS (SELECT c.src, c.dst, count(*) FILTER (x.m = y.m) AS z FROM c JOIN h x ON x.id = c.src JOIN h y ON y.id = c.dst AND y.k = x.k GROUP BY c.src, c.dst)
    SELECT v.id, round(coalesce(sum(z.z / CAST(z.z + {TRIANGLE_ROUNDS} AS DOUBLE) * (p.deg + q.deg)), 0) / 2 + 1e-10, 6) AS estimate
    FROM v LEFT JOIN z ON z.src = v.id LEFT JOIN d p ON p.id = z.src LEFT JOIN d q ON q.id = z.dst GROUP BY v.id"""
)
def triangles_minhash(spark, sf_dir):
    return rounded(triangles.triangles_minhash(fixtures.copurchase(spark, sf_dir), TRIANGLE_ROUNDS), "estimate")


# page index, order, mutation -------------------------------------------------------------------------

PAGES_SQL = ", p AS MATERIALIZED (SELECT src, dst, weight, CAST(row_number() OVER (ORDER BY src, dst, weight) - 1 AS BIGINT) AS row FROM e), g AS MATERIALIZED (SELECT *, row // 256 AS page_id FROM p)"
HASHES = "[({0} * 2654435761) & 4294967295, (({0} + 1) * 2246822519) & 4294967295]"
BITS_SQL = "list_distinct(flatten([[CAST(x & 4095 AS INTEGER), CAST((x >> 16) & 4095 AS INTEGER)] for x in " + HASHES + "]))"
INDEX_SQL = PAGES_SQL + ", i AS MATERIALIZED (SELECT DISTINCT page_id, unnest(" + BITS_SQL.format("src") + ") AS bit FROM g)"


@query(PART + INDEX_SQL + " SELECT page_id, bit FROM i")
def page_index(spark, sf_dir):
    return pageindex.pages_of(pageindex.filters(pageindex.paged(fixtures.part_edges(spark, sf_dir).edges), 4096)).select("page_id", "bit")


@query(
    PART + INDEX_SQL + f""", f AS (SELECT id, unnest({BITS_SQL.format('id')}) AS bit, len({BITS_SQL.format('id')}) AS need FROM v WHERE id % 200 = 0),
    q AS (SELECT f.id, i.page_id FROM f JOIN i ON i.bit = f.bit GROUP BY f.id, i.page_id, f.need HAVING count(*) = f.need) SELECT DISTINCT page_id FROM q"""
)
def page_probe(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    index = pageindex.filters(pageindex.paged(graph.edges), 4096)
    return pageindex.probe(index, graph.vertices.where("id % 200 = 0"), 4096)


@query(ORACLE_SQL["bfs"])
def bfs_selective(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir).unweighted()
    index = pageindex.PageIndex.create(graph.edges)
    return pageindex.run_selective(graph, traversal.bfs_program(graph, root_of(graph)), index).state.select("id", "v.level", "v.parent")


@query(
    PART + f""", a AS (SELECT src, CAST(row_number() OVER (ORDER BY src, dst, weight) - 1 AS BIGINT) AS row FROM e WHERE dst % 5 <> 0),
    b AS (SELECT src, (SELECT count(*) FROM a) + CAST(row_number() OVER (ORDER BY src, dst, weight) - 1 AS BIGINT) AS row FROM e WHERE dst % 5 = 0)
    SELECT DISTINCT row // 256 AS page_id, unnest({BITS_SQL.format('src')}) AS bit FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
)
def index_update(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges
    index = pageindex.PageIndex.create(edges.where("dst % 5 <> 0"), bits=4096)
    index.append(edges.where("dst % 5 = 0"))
    return index.filters()


@query("SELECT true AS built, true AS appended, false AS after_deletion, true AS rebuilt")
def index_verify(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges
    index = pageindex.PageIndex.create(edges.where("dst % 5 <> 0"))
    found = [index.verify()]
    for change in (lambda: index.append(edges.where("dst % 5 = 0")), lambda: index.delete(F.col("src") % 3 == 0), index.rebuild):
        change()
        found.append(index.verify())
    return spark.createDataFrame([tuple(found)], "built boolean, appended boolean, after_deletion boolean, rebuilt boolean")


LIVE_BFS = PART + ", live AS (SELECT src, dst FROM e WHERE (src + 3 * dst) % 10 <> 0)" + BFS_SQL.replace("FROM e\n", "FROM live\n").replace("JOIN e ON", "JOIN live e ON")


@query(LIVE_BFS + " SELECT id, level, parent FROM b")
def bfs_deleted(spark, sf_dir):
    """Over deleted edges, with the filters that they left."""
    graph = fixtures.part_edges(spark, sf_dir).unweighted()
    index = pageindex.PageIndex.create(graph.edges)
    index.delete((F.col("src") + 3 * F.col("dst")) % 10 == 0)
    live = graph.with_edges(index.edges.where("not is_deleted"))
    return pageindex.run_selective(live, traversal.bfs_program(live, root_of(live)), index).state.select("id", "v.level", "v.parent")


def _versions(spark, sf_dir) -> store.EdgeStore:
    """Version 1 lacks some edges, 2 has all, 3 has lost the heavy ones, 4 is as 3 in new pages."""
    edges = fixtures.part_edges(spark, sf_dir).edges
    held = store.EdgeStore.create(edges.where("src % 4 <> 3"))
    held.append(edges.where("src % 4 = 3"))
    held.delete(F.col("weight") >= 7)
    held.purge()
    return held


@query(
    PART + """ SELECT CAST(1 AS INTEGER) AS version, src, dst, weight FROM e WHERE src % 4 <> 3 UNION ALL SELECT 2, src, dst, weight FROM e
    UNION ALL SELECT 3, src, dst, weight FROM e WHERE weight < 7 UNION ALL SELECT 4, src, dst, weight FROM e WHERE weight < 7"""
)
def edges_as_of(spark, sf_dir):
    held = _versions(spark, sf_dir)
    rows = [held.snapshot(v).edges.select(F.lit(v).alias("version"), "src", "dst", "weight") for v in held.versions()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(PART + ", r AS (SELECT src, dst, weight, CAST(row_number() OVER (ORDER BY src, dst, weight) - 1 AS BIGINT) AS row FROM e) SELECT row, row // 256 AS page_id, src, dst, weight FROM r WHERE src % 7 <> 2 AND weight < 7")
def edges_delete_vector(spark, sf_dir):
    """After two deletions, one by a table of edges and one by a condition: what is left keeps its place."""
    edges = fixtures.part_edges(spark, sf_dir).edges
    held = store.EdgeStore.create(edges)
    held.delete(edges.where("src % 7 = 2").select("src", "dst"))
    return held.delete(F.col("weight") >= 7).edges.select("row", "page_id", "src", "dst", "weight")


LIGHT_BFS = PART + ", live AS (SELECT src, dst FROM e WHERE weight < 7)" + BFS_SQL.replace("FROM e\n", "FROM live\n").replace("JOIN e ON", "JOIN live e ON")


@query(LIGHT_BFS + " SELECT id, level, parent FROM b")
def bfs_snapshot(spark, sf_dir):
    """Over the version with deletion vectors, by its filters and ranges of pages."""
    graph = fixtures.part_edges(spark, sf_dir)
    version = _versions(spark, sf_dir).snapshot(3)
    live = Graph(version.edges.select("src", "dst"), graph.vertices)
    return version.run(live, traversal.bfs_program(live, root_of(live))).state.select("id", "v.level", "v.parent")


@query(PART + BFS_SQL + ", n AS (SELECT level, count(*) AS n FROM b GROUP BY level) SELECT CAST(a.level AS BIGINT) AS phase, a.n AS active, coalesce(c.n, 0) AS changed FROM n a LEFT JOIN n c ON c.level = a.level + 1")
def superstep_metrics(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir).unweighted()
    return run_monotone(graph, traversal.bfs_program(graph, root_of(graph)), ahead=1).metrics().select("phase", "active", "changed")


@query(
    PART + BFS_SQL + """, n AS (SELECT level, count(*) AS n FROM b GROUP BY level),
    m AS (SELECT b.level, count(*) AS messages, count(DISTINCT e.dst) AS arrived FROM b JOIN e ON e.src = b.id GROUP BY b.level)
    SELECT CAST(a.level AS BIGINT) AS phase, a.n AS active, coalesce(m.messages, 0) AS messages, coalesce(m.arrived, 0) AS arrived, coalesce(c.n, 0) AS changed
    FROM n a LEFT JOIN m ON m.level = a.level LEFT JOIN n c ON c.level = a.level + 1"""
)
def superstep_io(spark, sf_dir):
    """What each superstep sent; the bytes, rows and seconds beside it differ from run to run."""
    graph = fixtures.part_edges(spark, sf_dir).unweighted()
    return run_monotone(graph, traversal.bfs_program(graph, root_of(graph)), measured=True).metrics().select("phase", "active", "messages", "arrived", "changed")


@query(PART + BFS_SQL + " SELECT CAST(level - 1 AS BIGINT) AS phase, count(*) AS changed, CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS least FROM b WHERE level > 0 GROUP BY level")
def monotone_metrics(spark, sf_dir):
    """Accumulators of a frontier program, taken as each superstep is written."""
    graph = fixtures.part_edges(spark, sf_dir).unweighted()
    program = replace(traversal.bfs_program(graph, root_of(graph)), metrics={"id_sum": F.sum("id"), "least": F.min("id")})
    return run_monotone(graph, program).metrics().where("changed > 0").select("phase", "changed", "id_sum", "least")


PROGRAM_STEPS = 3
PROGRAM_SQL = PART + unrolled("x", "SELECT id, id AS x FROM v", lambda k: f"SELECT p.id, greatest(p.x, coalesce(max(q.x), p.x)) AS x FROM x{k - 1} p LEFT JOIN e ON e.dst = p.id LEFT JOIN x{k - 1} q ON q.id = e.src GROUP BY p.id, p.x", PROGRAM_STEPS) + f" SELECT id, x FROM x{PROGRAM_STEPS}"


@query(PROGRAM_SQL)
def vertex_program(spark, sf_dir):
    program = VertexProgram(init={"x": F.col("id")}, message={"m": F.col("x")}, combine={"m": F.max("m")}, apply={"x": F.greatest("x", F.coalesce("m", "x"))}, phases=PROGRAM_STEPS)
    return run(fixtures.part_edges(spark, sf_dir).unweighted(), program).state.select("id", "x")


@query(PROGRAM_SQL.rpartition(" SELECT ")[0] + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({k - 1} AS BIGINT) AS phase, CAST(sum(x) AS BIGINT) AS total FROM x{k}" for k in range(1, PROGRAM_STEPS + 1)) + ")")
def program_metrics(spark, sf_dir):
    """A sum over all states after each superstep."""
    program = VertexProgram(
        init={"x": F.col("id")}, message={"m": F.col("x")}, combine={"m": F.max("m")}, apply={"x": F.greatest("x", F.coalesce("m", "x"))}, phases=PROGRAM_STEPS, metrics={"total": F.sum("x")}
    )
    return run(fixtures.part_edges(spark, sf_dir).unweighted(), program).metrics()


@query(PROGRAM_SQL)
def batch_program(spark, sf_dir):
    """The same by Python functions over Arrow batches."""

    def scatter(edges: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([edges.column("dst"), edges.column("x")], names=["dst", "m"])

    def gather(state: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([state.column("id"), pc.max_element_wise(state.column("x"), state.column("m"))], names=["id", "x"])

    program = BatchProgram(init={"x": F.col("id")}, state="id long, x long", messages="dst long, m long", scatter=scatter, combine={"m": F.max("m")}, gather=gather, phases=PROGRAM_STEPS)
    return run_batches(fixtures.part_edges(spark, sf_dir).unweighted(), program).state


@query(PART + " SELECT v.id, coalesce(sum(e.weight * (e.src % 7)), 0.0) AS y FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def spmv_x(spark, sf_dir):
    graph = fixtures.part_edges(spark, sf_dir)
    return scans.spmv(graph, graph.vertices.select("id", (F.col("id") % 7).cast("double").alias("x")))


@query(PART + " SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM e")
def sort_check(spark, sf_dir):
    return sorting.is_sorted(sorting.numbered(fixtures.part_edges(spark, sf_dir).edges, "src", "dst"), "row", "src", "dst")


@query(PART + " SELECT src, dst, weight, src % 4 = 0 AS is_deleted FROM e")
def edges_delete_named(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges
    return mutation.delete_edges(edges, edges.where("src % 4 = 0").select("src", "dst"))


@query(PART + PAGES_SQL + " SELECT src, dst, weight, row, page_id FROM g")
def sort_edges(spark, sf_dir):
    return pageindex.paged(fixtures.part_edges(spark, sf_dir).edges).select("src", "dst", "weight", "row", "page_id")


LOCAL_BITS = "[CAST(x AS INTEGER) for x in flatten([[y & 4095, (y >> 16) & 4095] for y in " + HASHES.format("src") + "])]"


@query(
    PART + f""", q AS (SELECT src, dst, {LOCAL_BITS} AS pos FROM e)
    SELECT src, dst, CAST(row_number() OVER (ORDER BY list_sort([x >> 9 for x in pos]), list_sort([x >> 6 for x in pos]), list_sort([x >> 3 for x in pos]), src, dst) - 1 AS BIGINT) AS row FROM q"""
)
def locality_sort(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges.select("src", "dst")
    return sorting.numbered(edges, *sorting.locality_keys(4096, 3)).select("src", "dst", "row")


ORDER_BITS = 256
ORDER_POS = f"[CAST(x AS INTEGER) for x in flatten([[y & {ORDER_BITS - 1}, (y >> 16) & {ORDER_BITS - 1}] for y in " + HASHES + "])]"


@query(
    COP + f""", q AS MATERIALIZED (SELECT src, dst, {ORDER_POS.format('src')} AS pos FROM c),
    o AS (SELECT 'source' AS edge_order, src, pos, row_number() OVER (ORDER BY src, dst) - 1 AS row FROM q
        UNION ALL SELECT 'locality', src, pos, row_number() OVER (ORDER BY {', '.join(f'list_sort([x >> {s} for x in pos])' for s in reversed(range(ORDER_BITS.bit_length() - 1)))}, src, dst) - 1 FROM q),
    g AS MATERIALIZED (SELECT edge_order, src, pos, row // 256 AS page_id FROM o),
    i AS (SELECT DISTINCT edge_order, page_id, unnest(pos) AS bit FROM g),
    f AS (SELECT id, list_distinct({ORDER_POS.format('id')}) AS places FROM v WHERE id % 200 = 0),
    b AS (SELECT id, unnest(places) AS bit, len(places) AS need FROM f),
    h AS (SELECT i.edge_order, i.page_id FROM b JOIN i USING (bit) GROUP BY i.edge_order, i.page_id, b.id, b.need HAVING count(*) = b.need),
    p AS (SELECT edge_order, max(page_id) + 1 AS pages, count(DISTINCT page_id) FILTER (src % 200 = 0) AS holding FROM g GROUP BY edge_order)
    SELECT edge_order, pages, holding, count(DISTINCT h.page_id) AS hit FROM p LEFT JOIN h USING (edge_order) GROUP BY edge_order, pages, holding"""
)
def pages_hit_by_order(spark, sf_dir):
    """Pages that a fixed frontier hits where edges lie by source, and where they lie by locality."""
    graph = fixtures.copurchase(spark, sf_dir)
    sources, frontier = cut(graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "sources"), graph.vertices.where("id % 200 = 0")
    orders = {"source": ("src",), "locality": sorting.source_keys(ORDER_BITS, ORDER_BITS.bit_length() - 1)}
    return union([pageindex.pages_hit(sources, frontier, *keys, bits=ORDER_BITS).withColumn("edge_order", F.lit(name)) for name, keys in orders.items()])


@query(PART + ", p AS (SELECT src, dst, row_number() OVER (ORDER BY dst, src) AS row FROM e), q AS (SELECT (src, dst) < lag((src, dst)) OVER (ORDER BY row) AS less FROM p) SELECT count(*) AS n, count(*) FILTER (less) AS out_of_order FROM q")
def order_violations(spark, sf_dir):
    """How far edges in the order of their targets are from the order of their sources."""
    return sorting.is_sorted(sorting.numbered(fixtures.part_edges(spark, sf_dir).edges, "dst", "src"), "row", "src", "dst")


@query(PART + " SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src % 10 = 0")
def edges_append(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges
    more = edges.where("src % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return mutation.append_edges(edges, more)


@query(PART + " SELECT src, dst, weight, (src + 3 * dst) % 10 = 0 AS is_deleted FROM e")
def edges_delete(spark, sf_dir):
    return mutation.delete_edges(fixtures.part_edges(spark, sf_dir).edges, (F.col("src") + 3 * F.col("dst")) % 10 == 0)


@query(
    PART + """, k AS (SELECT src, dst, weight, CAST(row_number() OVER (ORDER BY src, dst, weight) - 1 AS BIGINT) AS row FROM e WHERE (src + 3 * dst) % 10 <> 0)
    SELECT src, dst, weight, row, row // 256 AS page_id FROM k"""
)
def edges_purge(spark, sf_dir):
    stored = pageindex.paged(fixtures.part_edges(spark, sf_dir).edges)
    return mutation.purge(mutation.delete_edges(stored, (F.col("src") + 3 * F.col("dst")) % 10 == 0)).select("src", "dst", "weight", "row", "page_id")


# streaming, sources, generators ----------------------------------------------------------------------

ONLINE_DAYS = 6
#: Records that a batch of the replay takes.
REPLAYED = 500


def _online_sql(edges: str, batch: str) -> str:
    return f"""WITH RECURSIVE {edges},
    n AS MATERIALIZED (SELECT DISTINCT {batch} AS batch_id, a, b FROM t),
    k AS (SELECT DISTINCT batch_id FROM n),
    x AS MATERIALIZED (SELECT DISTINCT k.batch_id, n.a AS src, n.b AS dst FROM k JOIN n ON n.batch_id <= k.batch_id),
    s AS MATERIALIZED (SELECT * FROM x UNION SELECT batch_id, dst, src FROM x),
    l(batch_id, id, c) USING KEY (batch_id, id) AS (
        SELECT DISTINCT batch_id, src, src FROM s
        UNION
        SELECT m.batch_id, m.id, m.c FROM (SELECT l.batch_id, s.dst AS id, min(l.c) AS c FROM l JOIN s ON s.batch_id = l.batch_id AND s.src = l.id GROUP BY l.batch_id, s.dst) m
        JOIN recurring.l r ON r.batch_id = m.batch_id AND r.id = m.id WHERE m.c < r.c),
    n2 AS (SELECT batch_id, count(*) FILTER (id = c) AS n_components, count(*) FILTER (id <> c) AS given_up FROM l GROUP BY batch_id)
    SELECT batch_id, n_components, given_up - lag(given_up, 1, 0) OVER (ORDER BY batch_id) AS merges FROM n2"""


@query(_online_sql(EVENT_EDGES_SQL, f"date_diff('day', (SELECT min(day) FROM t), day) // {ONLINE_DAYS}"))
def cc_online(spark, sf_dir):
    edges = fixtures.event_edges(spark, sf_dir)
    first = edges.agg(F.min("day")).first()[0]
    edges = edges.select(F.floor(F.datediff("day", F.lit(first)) / ONLINE_DAYS).cast("int").alias("batch"), F.col("a").alias("src"), F.col("b").alias("dst"))
    batches = sorted(r.batch for r in edges.select("batch").distinct().collect())  # a row for each batch
    folder = work_path(spark, "edge-batches")
    online.feed([edges.where(F.col("batch") == b) for b in batches], folder)
    return online.cc_online(online.edge_stream(spark, folder)).counts()


@query(_online_sql(PART_EDGES_SQL + ", t AS (SELECT row_number() OVER (ORDER BY weight, src, dst) - 1 AS row, src AS a, dst AS b FROM e)", f"row // {REPLAYED}"))
def cc_online_replay(spark, sf_dir):
    """Edges as records in the order of their weights, replayed so many a batch."""
    folder = work_path(spark, "replay")
    edgefiles.write_in_order(fixtures.part_edges(spark, sf_dir).edges, folder, "weight", "src", "dst")
    return online.cc_replay(spark, folder, REPLAYED).counts()


@query(PART + " SELECT src, dst, weight FROM e")
def binary_roundtrip(spark, sf_dir):
    folder = work_path(spark, "binary")
    edgefiles.write_binary(fixtures.part_edges(spark, sf_dir).edges, folder, 12)
    return edgefiles.read_binary(spark, folder, 12)


@query(PART + " SELECT src, dst, weight FROM e")
def matrix_market_roundtrip(spark, sf_dir):
    graph, folder = fixtures.part_edges(spark, sf_dir), work_path(spark, "matrix-market")
    edgefiles.write_matrix_market(graph.edges, folder, graph.meta)
    return edgefiles.read_matrix_market(spark, folder, weighted=True)[0]


@query(PART + " SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def pairs_roundtrip(spark, sf_dir):
    folder = work_path(spark, "pairs")
    edgefiles.write_pairs(fixtures.part_edges(spark, sf_dir).edges, folder)
    return edgefiles.read_snap(spark, folder).select("src", "dst")


@query(PART + " SELECT src, dst FROM e")
def binary8_roundtrip(spark, sf_dir):
    folder = work_path(spark, "binary")
    edgefiles.write_binary(fixtures.part_edges(spark, sf_dir).edges, folder, 8)
    return edgefiles.read_binary(spark, folder, 8)


@query(PART + " SELECT src, dst, weight FROM e")
def binary16_roundtrip(spark, sf_dir):
    folder = work_path(spark, "binary")
    edgefiles.write_binary(fixtures.part_edges(spark, sf_dir).edges, folder, 16)
    return edgefiles.read_binary(spark, folder, 16)


@query(PART + " SELECT src, dst FROM e")
def matrix_market_pattern(spark, sf_dir):
    graph, folder = fixtures.part_edges(spark, sf_dir).unweighted(), work_path(spark, "matrix-market")
    edgefiles.write_matrix_market(graph.edges, folder, graph.meta)
    return edgefiles.read_matrix_market(spark, folder)[0].select("src", "dst")


@query(PART + " SELECT 'part_edges' AS name, true AS weighted, (SELECT count(*) FROM v) AS n_vertices, count(*) AS n_edges FROM e")
def descriptor_roundtrip(spark, sf_dir):
    folder = work_path(spark, "descriptor")
    edgefiles.write_descriptor(fixtures.part_edges(spark, sf_dir).meta, f"{folder}/graph.ini")
    meta = edgefiles.read_descriptor(f"{folder}/graph.ini")
    return spark.createDataFrame([(meta.name, meta.weighted, meta.n_vertices, meta.n_edges)], "name string, weighted boolean, n_vertices long, n_edges long")


def _as_text(lines: DataFrame, label: str) -> str:
    folder = work_path(lines.sparkSession, label)
    lines.write.text(folder)
    return folder


@query(PART + " SELECT src, dst FROM e")
def numbered_pairs(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges
    return edgefiles.read_pairs(spark, _as_text(edges.select(F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")).alias("value")), "pairs")).select("src", "dst")


@query(PART + " SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def adjacency_lists(spark, sf_dir):
    edges = fixtures.part_edges(spark, sf_dir).edges
    lists = edges.groupBy("src").agg(F.count("*").alias("n"), F.concat_ws(" ", F.collect_list(F.col("dst").cast("string"))).alias("to"))
    return edgefiles.read_adjacency(spark, _as_text(lists.select(F.concat_ws(" ", "src", "n", "to").alias("value")), "adjacency")).select("src", "dst")


@query(
    """WITH r AS (SELECT l_suppkey AS src, l_partkey AS user, max(CAST(l_quantity AS INTEGER) % 5 + 1) AS weight FROM lineitem WHERE l_suppkey < 8 GROUP BY 1, 2)
    SELECT src, 17769 + dense_rank() OVER (ORDER BY user) AS dst, CAST(weight AS DOUBLE) AS weight FROM r"""
)
def rating_files(spark, sf_dir):
    """Eight suppliers as movies, a file each."""
    lines = fixtures.table(spark, sf_dir, "lineitem").where("l_suppkey < 8").groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_quantity").cast("int") % 5 + 1).alias("rating"))
    folder = work_path(spark, "ratings")

    def write(table: pa.Table) -> pa.Table:
        movie = table.column("l_suppkey")[0].as_py() + 1
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/mv_{movie:07d}.txt") as out:
            out.write(f"{movie}:\n".encode() + "".join(f"{u},{r},2005-01-01\n" for u, r in zip(table.column("l_partkey").to_pylist(), table.column("rating").to_pylist())).encode())
        return pa.table({"movie": pa.array([movie], pa.int64())})

    lines.groupBy("l_suppkey").applyInArrow(write, "movie long").collect()  # a row for each of the eight files
    return edgefiles.read_ratings(spark, folder)


def _mixed_steps(seed: int, kinds: list[int], n: int) -> str:
    """CTEs that make the hashes u<kind> of the ids below ``n``, a step at a time."""
    step = lambda x: f"xor({x}, {x} >> 16)"
    mix = lambda x: f"(({step(x)}) * 73244475) & 4294967295"
    sql, last = f"WITH i AS (SELECT CAST(range AS BIGINT) AS id FROM range({n}))", "i"
    seeds = {}
    for k in kinds:  # the hash of seed and kind is a constant
        x = 0
        for part in (seed, k):
            x = (x * 31 + part) & 4294967295
            for _ in range(2):
                x = ((x ^ x >> 16) * 73244475) & 4294967295
        seeds[k] = x
    for name, expr in (("a", lambda k: f"({seeds[k]}::BIGINT * 31 + id) & 4294967295"), ("b", lambda k: mix(f"a{k}")), ("c", lambda k: mix(f"b{k}")), ("u", lambda k: step(f"c{k}"))):
        sql += f", {name} AS (SELECT *, " + ", ".join(f"{expr(k)} AS {name}{k}" for k in kinds) + f" FROM {last})"
        last = name
    return sql


@query(_mixed_steps(1, [1, 2], 20000) + ", d AS (SELECT u1 % 4096 AS src, u2 % 4096 AS dst FROM u) SELECT src, CASE WHEN src = dst THEN (dst + 1) % 4096 ELSE dst END AS dst FROM d")
def erdos_renyi(spark, sf_dir):
    return generators.erdos_renyi(spark, 4096, 20000)


@query(_mixed_steps(1, [1, 2], 20000) + " SELECT u1 % 1000 AS src, 1000 + u2 % 3096 AS dst FROM u")
def bipartite(spark, sf_dir):
    return generators.bipartite(spark, 1000, 4096, 20000)


def _rmat_sql(scale: int, n: int) -> str:
    down = lambda k: f"CAST(u{4 * k} / 4294967296.0::DOUBLE >= 0.57::DOUBLE + 0.19::DOUBLE AS BIGINT)"
    right = lambda k: f"CAST(u{4 * k} / 4294967296.0::DOUBLE >= 0.57::DOUBLE AND u{4 * k} / 4294967296.0::DOUBLE < 0.57::DOUBLE + 0.19::DOUBLE OR u{4 * k} / 4294967296.0::DOUBLE >= 0.57::DOUBLE + 0.19::DOUBLE + 0.19::DOUBLE AS BIGINT)"
    sums = (" + ".join(f"{1 << scale - 1 - k} * {f(k)}" for k in range(scale)) for f in (down, right))
    return _mixed_steps(1, [4 * k for k in range(scale)], n) + " SELECT {} AS src, {} AS dst FROM u".format(*sums)


@query(_rmat_sql(12, 20000))
def rmat(spark, sf_dir):
    return generators.rmat(spark, 12, 20000, noise=0)


def _noisy_rmat_sql(scale: int, n: int, noise: float = 0.05) -> str:
    """As above with chances varied by level, a weight, and both directions."""
    chances = (0.57, 0.19, 0.19, 1 - 0.57 - 0.19 - 0.19)
    names = {f"u{k}": (1, 4 * k) for k in range(scale)} | {f"n{k}_{q}": (2, 4 * k + q) for k in range(scale) for q in range(4)} | {"weight": (1, 3)}
    step = lambda x: f"xor({x}, {x} >> 16)"
    mix = lambda x: f"(({step(x)}) * 73244475) & 4294967295"
    folded = {}
    for name, parts in names.items():
        x = 0
        for part in parts:
            x = (x * 31 + part) & 4294967295
            for _ in range(2):
                x = ((x ^ x >> 16) * 73244475) & 4294967295
        folded[name] = x
    sql = f"WITH i AS (SELECT CAST(range AS BIGINT) AS id FROM range({n}))"
    sql += ", a AS (SELECT id, " + ", ".join(f"({x}::BIGINT * 31 + id) & 4294967295 AS {name}" for name, x in folded.items()) + " FROM i)"
    for after, before, expr in (("b", "a", mix), ("c", "b", mix), ("d", "c", step)):
        sql += f", {after} AS (SELECT id, " + ", ".join(f"{expr(name)} AS {name}" for name in names) + f" FROM {before})"
    varied = lambda k, q: f"{chances[q]!r}::DOUBLE * ({1 - noise!r}::DOUBLE + {2 * noise / 2**32!r}::DOUBLE * n{k}_{q})"
    sql += ", p AS (SELECT id, weight / 4294967296.0::DOUBLE AS weight, " + ", ".join(f"u{k} / 4294967296.0::DOUBLE AS u{k}, " + ", ".join(f"{varied(k, q)} AS p{k}_{q}" for q in range(4)) for k in range(scale)) + " FROM d)"
    sql += ", q AS (SELECT *, " + ", ".join(f"u{k} * (p{k}_0 + p{k}_1 + p{k}_2 + p{k}_3) AS x{k}" for k in range(scale)) + " FROM p)"
    down = " + ".join(f"{1 << scale - 1 - k} * CAST(x{k} >= p{k}_0 + p{k}_1 AS BIGINT)" for k in range(scale))
    right = " + ".join(f"{1 << scale - 1 - k} * CAST(x{k} >= p{k}_0 AND x{k} < p{k}_0 + p{k}_1 OR x{k} >= p{k}_0 + p{k}_1 + p{k}_2 AS BIGINT)" for k in range(scale))
    return sql + f", m AS (SELECT {down} AS src, {right} AS dst, weight FROM q) SELECT src, dst, weight FROM m UNION ALL SELECT dst, src, weight FROM m"


@query(_noisy_rmat_sql(10, 8000))
def rmat_noise(spark, sf_dir):
    return generators.rmat(spark, 10, 8000, weighted=True, symmetric=True)
