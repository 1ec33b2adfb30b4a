"""The Merkle manifest against a plain tree, with small blocks and top trees so that all paths are taken."""

import hashlib
import random
import zlib

import pytest

from tidegraph.llm import merkle

rng = random.Random(13)
H = lambda *parts: hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def plain_leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_tree(nodes):
    """The root and the siblings (left, right) of each node, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            low = i // 3 * 3
            way.append((nodes[low:i], nodes[i + 1 : low + 3]))
        nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], ways


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        built[s] = plain_tree([plain_leaf(r) for r in trees[s]])
    root, over = plain_tree([built[s][0] for s in names])
    out = []
    for s, above in zip(names, over):
        for r, way in zip(trees[s], built[s][1]):
            way = way + above
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = plain_leaf((*r[:4], text))
            for left, right in way:
                node = H(*left, node, *right)
            out.append((r[0], plain_leaf(r), built[s][0], root, H(*(x for left, right in way for x in left + right)), node, node == root))
    return sorted(out, key=str)


def rows_of(n, sources):
    texts = [None, "", "a\nb", "plain", "é\n\nß", "\n"]
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3, 40]), rng.choice(texts)) for i in rng.sample(range(-50, 10 * n), n)]


@pytest.mark.parametrize("n, sources, block, top", [(1, ["a"], 2187, 19683), (40, ["a", None, "é", ""], 2187, 19683), (150, ["hot"] * 6 + ["b", None, "c"], 9, 19683), (150, ["hot"] * 6 + ["b", None, "c"], 3, 4), (60, [f"s{i}" for i in range(40)], 3, 5), (28, ["a"], 9, 2)])
def test_as_a_plain_tree(spark, n, sources, block, top):
    rows = rows_of(n, sources)
    rows += [rows[0]] * 2 + [(None, rows[0][1], None, None, "x\ny")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block, top=top)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_other_tampering_extra_columns_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    rows = rows_of(12, ["a", "b"])
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, POS int")
    assert merkle.manifest(docs.where("false")).count() == 0
    changed = {r.doc_id: r.verified for r in merkle.manifest(docs, tampered=F.when(F.col("doc_id") == rows[3][0], F.lit("forged"))).collect()}
    assert [d for d, ok in changed.items() if not ok] == [rows[3][0]]
    assert [tuple(r) for r in merkle.manifest(docs).orderBy("doc_id").collect()] == sorted(plain(rows), key=lambda r: r[0])


def test_a_very_long_text(spark):
    rows = [(2, "a", None, None, "x\n" * 3_000_000), (3, "a", None, None, "y")]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)
