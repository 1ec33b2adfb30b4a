"""The driver contract, and cheap queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
CHEAP = ["degree_cnt", "conductance", "spmv", "checkbip", "pagerank", "bp_seeded", "triangles_exact", "page_index", "page_probe", "sort_edges", "edges_purge", "erdos_renyi", "bfs", "als", "mcst_summary", "index_update", "batch_program", "numbered_pairs", "adjacency_lists", "rating_files", "matrix_market_pattern", "edges_delete_vector", "cc_blocks", "pages_hit_by_order", "order_violations", "monotone_metrics", "program_metrics", "hyperanf", "binary16_roundtrip", "mis"]


def test_every_sql_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert all(map(callable, queries.values()))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_sql_says_the_same(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("lineitem", "part", "supplier", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got = entry.queries()[name](spark, TABLES)
    columns = sorted(got.columns)
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(map(tuple, found), key=key)


def test_hyperanf_takes_all_lines_to_the_end(spark, tmp_path):
    """Orders of any quantity, in a chain longer than a few steps."""
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE part AS SELECT range AS p_partkey FROM range(12)")
    db.execute("CREATE TABLE lineitem AS SELECT o.range AS l_orderkey, o.range + l.range AS l_partkey, CAST(16 + 3 * o.range AS DOUBLE) AS l_quantity FROM range(10) o, range(2) l")
    for table in ("part", "lineitem"):
        db.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in entry.queries()["hyperanf"](spark, str(tmp_path)).orderBy("t").collect()]
    assert got == db.execute(f"SELECT t, estimate, seed, seed_reach FROM ({entry.oracle_sql()['hyperanf']}) ORDER BY t").fetchall()
    assert [r[0] for r in got] == list(range(12)) and got[-1][1:] == got[-2][1:] and got[10][1] > got[9][1] > got[0][1]
