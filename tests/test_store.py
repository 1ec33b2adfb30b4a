"""Page index, order, mutation, files, generators and the online components."""

import struct

import pytest
from pyspark.sql import functions as F

from tidegraph.graph import Graph, GraphMeta
from tidegraph.operators import mutation, pageindex, sorting, traversal
from tidegraph.plans.superstep import run_monotone
from tidegraph.sources import edgefiles, generators
from tidegraph.streaming import online


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges(spark):
    return generators.erdos_renyi(spark, 400, 1500, seed=3).distinct().persist()


def test_numbering_and_order(spark, edges):
    numbered = sorting.numbered(edges, "src", "dst").orderBy("row").collect()
    assert [r.row for r in numbered] == list(range(len(numbered)))
    assert [(r.src, r.dst) for r in numbered] == sorted((r.src, r.dst) for r in numbered)
    assert rows(sorting.is_sorted(sorting.numbered(edges, "src", "dst"), "row", "src", "dst")) == [(len(numbered), 0)]
    assert rows(sorting.locality_sort(edges)) == rows(edges) == rows(sorting.sort_edges(edges))


def positions(v, bits):
    first, second = v * 2654435761 % 2**32, (v + 1) * 2246822519 % 2**32
    return [(h >> up) % bits for h in (first, second) for up in (0, 16)]


@pytest.mark.parametrize("bits, levels", [(256, 8), (4096, 3), (2, 1), (2**20, 4)])
def test_packed_keys_are_in_the_order_of_the_lists(spark, bits, levels):
    ids, width = list(range(0, 3000, 7)), bits.bit_length() - 1
    shifts = sorted({width * (levels - i) // (levels + 1) for i in range(levels)}, reverse=True)
    wide = {v: positions(v, bits) for v in ids}
    want = sorted(ids, key=lambda v: ([sorted(p >> s for p in wide[v]) for s in shifts], v))
    got = sorting.numbered(spark.createDataFrame([(i,) for i in ids], "src long"), *sorting.source_keys(bits, levels)).orderBy("row")
    assert [r.src for r in got.collect()] == want


def test_pages_hit_by_runs_of_sources(spark):
    """The places of a source's edges follow from its first one; a source may fill several pages and empty frontiers hit none."""
    degree = {v: 1 + v * v % 7 for v in range(0, 900, 2)} | {14: 150}
    sources, frontier = spark.createDataFrame(list(degree.items()), "src long, n long"), [v for v in range(-3, 900) if v % 45 == 0] + [14]
    at = {v: positions(v, 128) for v in range(-3, 1000)}
    for keys, order in (((F.col("src"),), lambda v: v), (sorting.source_keys(128, 7), lambda v: ([sorted(p >> s for p in at[v]) for s in (6, 5, 4, 3, 2, 1, 0)], v))):
        places = [v for v in sorted(degree, key=order) for _ in range(degree[v])]
        pages = [set(places[i : i + 16]) for i in range(0, len(places), 16)]
        bits = [{p for v in page for p in at[v]} for page in pages]
        want = (len(pages), sum(any(set(at[v]) <= b for v in frontier) for b in bits), sum(bool(p & set(frontier)) for p in pages))
        held = spark.createDataFrame([(v,) for v in [*frontier, None]], "id long")
        assert rows(pageindex.pages_hit(sources, held, *keys, bits=128, per_page=16)) == [want]
        assert rows(pageindex.pages_hit(sources, held.where("false"), *keys, bits=128, per_page=16)) == [(len(pages), 0, 0)]
    assert rows(pageindex.pages_hit(sources.where("false"), held, "src", bits=128)) == [(0, 0, 0)]


def test_a_probe_makes_no_row_for_an_id_and_a_block(spark):
    slices = spark.range(300 * 64).select((F.col("id") % 64).cast("int").alias("bit"), F.floor(F.col("id") / 64).cast("long").alias("block"), F.lit(-1).cast("long").alias("pages"))
    hit = pageindex.probe(slices, spark.range(5000), 64)
    assert hit.count() == 300 * 64
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Join Inner" not in plan


@pytest.mark.parametrize("bits", [64, 1024])
def test_probe_has_no_false_negatives(spark, edges, bits):
    stored = pageindex.paged(edges, per_page=16)
    frontier = spark.range(0, 400, 37)
    hit = {r[0] for r in pageindex.probe(pageindex.filters(stored, bits), frontier, bits).collect()}
    true = {r[0] for r in stored.join(frontier, stored.src == frontier.id).select("page_id").distinct().collect()}
    assert true <= hit


def test_selective_is_full(spark, edges):
    graph = Graph.dense(edges, 400)
    index = pageindex.PageIndex.create(graph.edges, per_page=16, bits=512)
    program = traversal.bfs_program(graph, 5)
    full, part = run_monotone(graph, program), pageindex.run_selective(graph, program, index)
    assert rows(full.state) == rows(part.state)
    assert rows(pageindex.run_selective(graph, program, index, max_check=1).state) == rows(full.state)


def test_slices_say_what_filters_hold(spark, edges):
    stored = pageindex.paged(edges, per_page=4)
    slices = pageindex.filters(stored, 256)
    want = stored.select("page_id", F.explode(pageindex.bloom_positions(F.col("src"), 256)).alias("bit")).distinct()
    assert rows(pageindex.pages_of(slices).select("page_id", "bit")) == rows(want)
    assert want.agg(F.max("page_id")).first()[0] > 4 * pageindex.GROUP


def test_deleted_edges_and_filters_that_say_too_much(spark, edges):
    index = pageindex.PageIndex.create(edges, per_page=16, bits=512)
    index.delete((F.col("src") + F.col("dst")) % 3 == 0)
    assert not index.verify()
    live = Graph.dense(edges.where("(src + dst) % 3 <> 0"), 400)
    program = traversal.bfs_program(live, 5)
    assert rows(pageindex.run_selective(live, program, index).state) == rows(run_monotone(live, program).state)
    index.rebuild()
    assert index.verify()
    index.append(edges.where("src < 10").select("src", "dst"))
    assert index.verify() and index.edges.where("not is_deleted").count() == live.edges.count() + edges.where("src < 10").count()


def test_folders_without_a_hit_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(pageindex, "PAGES_PER_FOLDER", 4)
    edges = spark.range(20000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    index = pageindex.PageIndex.create(edges, per_page=64, bits=4096)
    found = index.scan(spark.createDataFrame([(70,), (71,)], "id long"))
    assert {70, 71} <= {r.src for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan  # of the folders
    hit = pageindex.probe(index.index, spark.createDataFrame([(70,), (71,)], "id long"), 4096).count()
    assert found.count() <= 64 * hit < 20000 / 4


def test_filters_are_small_beside_the_edges(spark, tmp_path):
    edges = generators.rmat(spark, 16, 300_000, weighted=True)
    index = pageindex.PageIndex.create(edges, path=str(tmp_path / "i"))
    size = lambda x: sum(f.stat().st_size for f in (tmp_path / "i" / x).rglob("*.parquet"))
    assert size("index") < size("edges") / 5


def test_append_equals_rebuilding(spark, edges):
    first, more = edges.where("src < 300"), edges.where("src >= 300")
    index = pageindex.PageIndex.create(first, per_page=16, bits=512)
    assert index.verify()
    index.append(more)
    assert index.verify()
    assert rows(index.edges.select("src", "dst")) == rows(edges)
    assert [r.row for r in index.edges.orderBy("row").collect()] == list(range(edges.count()))


def test_delete_and_purge(spark, edges):
    stored = pageindex.paged(edges, per_page=16)
    gone = mutation.delete_edges(stored, (F.col("src") + F.col("dst")) % 3 == 0)
    named = mutation.delete_edges(stored, edges.where((F.col("src") + F.col("dst")) % 3 == 0))
    assert rows(gone.where("is_deleted").select("src", "dst")) == rows(named.where("is_deleted").select("src", "dst"))
    left = rows(edges.where((F.col("src") + F.col("dst")) % 3 != 0))
    assert rows(mutation.live(gone).select("src", "dst")) == left
    purged = mutation.purge(gone, per_page=16)
    assert rows(purged.select("src", "dst")) == left
    assert sorted(r.row for r in purged.collect()) == list(range(len(left)))
    bits = lambda df: df.agg(F.sum(F.bit_count("pages"))).first()[0]
    assert bits(pageindex.filters(gone, 256)) < bits(pageindex.filters(stored, 256))
    share = edges.where(mutation.drawn(30)).count() / edges.count()
    assert 0.2 < share < 0.4
    assert mutation.append_edges(edges, edges, 1).count() == 2 * edges.count()


@pytest.mark.parametrize("record", [8, 12, 16])
def test_binary(spark, edges, record, tmp_path):
    weighted = edges.withColumn("weight", (F.col("src") % 7).cast("double"))
    columns = ["src", "dst"] + ["weight"] * (record > 8)
    edgefiles.write_binary(weighted, f"{tmp_path}/e", record)
    assert rows(edgefiles.read_binary(spark, f"{tmp_path}/e", record)) == rows(weighted.select(*columns))
    one = tmp_path / "one.bin"
    one.write_bytes(struct.pack("<IIIIII", 1, 2, 2**32 - 1, 2**32 - 1, 3, 4))
    assert rows(edgefiles.read_binary(spark, str(one), 8)) == [(1, 2), (3, 4)]
    assert edgefiles.read_binary(spark, str(one), 8, keep_deleted=True).count() == 3
    one.write_bytes(b"1234567")
    with pytest.raises(ValueError):
        edgefiles.read_binary(spark, str(one), 8)


def test_text_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    pattern, n = edgefiles.read_matrix_market(spark, put("p.mtx", "%%MatrixMarket\n% note\n4 4 2\n1 2\n4 3\n"))
    assert rows(pattern.select("src", "dst")) == [(0, 1), (3, 2)] and n == 4
    real, _ = edgefiles.read_matrix_market(spark, put("r.mtx", "%%MatrixMarket\n4 4 2\n1 2 0.5\n4 3 2\n"), weighted=True)
    assert rows(real) == [(0, 1, 0.5), (3, 2, 2.0)]
    same, _ = edgefiles.read_matrix_market(spark, put("e.mtx", "%%MatrixMarket\n4 4 3\n4 4 3\n1 2 3\n4 4 3\n"), weighted=True)
    assert rows(same) == [(0, 1, 3.0), (3, 3, 3.0), (3, 3, 3.0)]  # edges that read like the size line
    assert rows(edgefiles.read_snap(spark, put("s.txt", "# x\n0\t5\n5\t6\n")).select("src", "dst")) == [(0, 5), (5, 0), (5, 6), (6, 5)]
    assert rows(edgefiles.read_pairs(spark, put("t.txt", "% x\n1 2\n3 1\n")).select("src", "dst")) == [(0, 1), (2, 0)]
    assert rows(edgefiles.read_adjacency(spark, put("y.txt", "0 2 1 2\n3 0\n4 1 0\n"), both_ways=False).select("src", "dst")) == [(0, 1), (0, 2), (4, 0)]
    put("mv_0000002.txt", "2:\n70,3,2005-01-01\n9,5,2005-01-01\n")
    assert rows(edgefiles.read_ratings(spark, str(tmp_path / "mv_*.txt"))) == [(1, 17770, 5.0), (1, 17771, 3.0)]
    meta = GraphMeta("g", True, 4, 2)
    edgefiles.write_matrix_market(real, str(tmp_path / "out"), meta)
    back, n = edgefiles.read_matrix_market(spark, str(tmp_path / "out"), weighted=True)
    assert rows(back) == rows(real) and n == 4
    edgefiles.write_pairs(real, str(tmp_path / "tsv"))
    assert rows(edgefiles.read_snap(spark, str(tmp_path / "tsv"), both_ways=False).select("src", "dst")) == [(0, 1), (3, 2)]
    edgefiles.write_descriptor(meta, str(tmp_path / "g.ini"))
    assert edgefiles.read_descriptor(str(tmp_path / "g.ini")) == meta


def test_generators(spark):
    for make in (lambda: generators.rmat(spark, 8, 2000), lambda: generators.erdos_renyi(spark, 200, 2000), lambda: generators.bipartite(spark, 50, 200, 2000)):
        assert rows(make()) == rows(make())
    random = generators.erdos_renyi(spark, 200, 2000)
    assert random.where("src = dst").isEmpty() and random.where("src >= 200 or dst >= 200").isEmpty()
    assert generators.bipartite(spark, 50, 200, 2000).where("src >= 50 or dst < 50 or dst >= 200").isEmpty()
    skewed = generators.rmat(spark, 8, 4000).groupBy("src").count().agg(F.max("count")).first()[0]
    assert skewed > 3 * generators.erdos_renyi(spark, 256, 4000).groupBy("src").count().agg(F.max("count")).first()[0]
    assert generators.rmat(spark, 6, 100, weighted=True, symmetric=True).count() == 200
    with pytest.raises(ValueError):
        generators.bipartite(spark, 0, 10, 5)


def test_online_components_equal_batch(spark, tmp_path):
    batches = [[(1, 2), (3, 4)], [(2, 3)], [(9, 9)], [(4, 7), (8, 9)], [(7, 8)]]
    frames = [spark.createDataFrame(b, "src long, dst long") for b in batches]
    folder = str(tmp_path / "batches")
    online.feed(frames, folder)
    state = online.cc_online(online.edge_stream(spark, folder), spark.range(1, 5))
    expected, seen = [], []
    for b in batches:
        seen += b
        graph = Graph(spark.createDataFrame(seen, "src long, dst long")).symmetrize()
        graph = Graph(graph.edges, graph.vertices.union(spark.range(1, 5)).distinct())
        expected.append(traversal.cc_count(traversal.cc(graph)).first()[0])
    assert [r.n_components for r in state.counts().orderBy("batch_id").collect()] == expected
    assert rows(state.labels) == rows(traversal.cc(graph))


def test_online_components_go_on_after_a_new_start(spark, tmp_path):
    batches = [[(1, 2), (3, 4)], [(2, 3)], [(9, 9)], [(4, 7), (8, 9)], [(7, 8)]]
    frames = [spark.createDataFrame(b, "src long, dst long") for b in batches]
    folder, state = str(tmp_path / "batches"), str(tmp_path / "state")
    online.feed(frames[:2], folder)
    online.cc_online(online.edge_stream(spark, folder), folder=state)
    online.feed(frames[2:], folder)
    (tmp_path / "state" / "batch-2" / "names").mkdir(parents=True)  # a batch that a lost driver did not end
    again = online.cc_online(online.edge_stream(spark, folder), folder=state)
    whole = online.cc_online(online.edge_stream(spark, folder), folder=str(tmp_path / "other"))
    assert rows(again.labels) == rows(whole.labels)
    assert rows(again.counts()) == rows(whole.counts()) and again.counts().count() == 5
    again.add(frames[0], 0)  # a batch that was whole already
    assert again.counts().count() == 5


def test_incremental_labels(spark):
    old = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "src long, dst long")
    labels = traversal.cc(Graph(old))
    grown = Graph(old.union(spark.createDataFrame([(2, 3), (3, 2)], "src long, dst long")))
    seeds = spark.createDataFrame([(2,), (3,)], "id long")
    assert rows(traversal.cc(grown, labels, seeds)) == rows(traversal.cc(grown))
