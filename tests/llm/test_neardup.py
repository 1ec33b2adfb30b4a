"""The near-duplicate stage against all pairs, on copies that differ by blocks, in large groups, and by repeats."""

import random

import numpy as np
import pytest

from tidegraph.llm import neardup, simhash

rng = random.Random(21)


def words(n):
    return ["".join(rng.choice("bcdfghaeiou") for _ in range(rng.randint(4, 9))) for _ in range(n)]


def shingles(text):
    return set(simhash.shingle_hashes(text.encode().lower(), 5, 42).tolist())


def jaccard(x, y):
    return len(x & y) / len(x | y)


def expected(rows, similarity=0.8):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in sets if find(i) == i)


def kept(spark, rows):
    return sorted(r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


BLOCKS = {
    "added": lambda w, k: w + words(k),
    "cut": lambda w, k: w[: len(w) - k],
    "replaced": lambda w, k: w[: len(w) - k // 2] + words(k // 2),
    "inside": lambda w, k: w[:40] + words(k) + w[40:],
}


@pytest.mark.parametrize("kind", BLOCKS)
def test_blocks(spark, kind):
    rows = []
    for pair in range(60):
        base = words(rng.randint(80, 300))
        for k in range(len(base) // 4, 0, -1):  # the largest block that leaves 0.80 to 0.90
            other = BLOCKS[kind](base, k)
            if 0.8 <= jaccard(shingles(" ".join(base)), shingles(" ".join(other))) <= 0.9:
                break
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
    assert expected(rows) == [2 * i for i in range(60)]
    assert kept(spark, rows) == expected(rows)


def test_short_texts(spark):
    rows = []
    for i in range(150):
        base = words(rng.randint(1, 24))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + words(rng.randint(1, 3))))]
    assert len(expected(rows)) < len(rows)
    assert kept(spark, rows) == expected(rows)


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_similar_sets_share_a_key(similarity):
    g = np.random.default_rng(3)
    for _ in range(3000):
        n = int(g.integers(1, 60))
        a = int(g.integers(0, n * (1 - similarity) + 1e-9 + 1))
        b = int(g.integers(0, max(0, (n - a) / similarity - n) + 1e-9 + 1))
        pool = g.integers(0, 2**64, n + b, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[a:])
        if n - a >= similarity * (n + b):
            assert set(neardup.keys(x, similarity).tolist()) & set(neardup.keys(y, similarity).tolist())


def test_variants_that_only_resemble_each_other(spark):
    """In a large group of copies of C, X and Y are like each other but not like C."""
    base = words(300)
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        copy = list(base)
        copy[rng.randrange(300)] = words(1)[0]
        rows.append((i, " ".join(copy)))
    for pair in range(6):
        x = base[: 300 - 40] + words(40)
        y = x[: 300 - 15] + words(15)
        rows += [(100 + 2 * pair, " ".join(x)), (101 + 2 * pair, " ".join(y))]
    centre, x, y = (shingles(rows[i][1]) for i in (0, -2, -1))
    assert jaccard(x, y) >= 0.8 > max(jaccard(x, centre), jaccard(y, centre))
    assert expected(rows) == [0, *range(100, 112, 2)]
    assert kept(spark, rows) == expected(rows)


def test_many_centres(spark, monkeypatch):
    """Each text that shares a passage with all others is compared with all of them."""
    monkeypatch.setattr(neardup, "MORE", 3)
    monkeypatch.setattr(neardup, "FIRST", 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    common, rows = words(60), []
    for i in range(0, 80, 2):
        own = words(60)
        rows += [(i, " ".join(common + own)), (i + 1, " ".join(common + own + words(12)))]
    assert expected(rows) == list(range(0, 80, 2))
    assert kept(spark, rows) == expected(rows)


def test_a_pair_that_shares_many_keys_is_seldom_repeated(spark, monkeypatch):
    """Fifteen variants of a text, each pair just below the limit and with many keys in common."""
    made, against = spark.sparkContext.accumulator(0), neardup._against

    def counting(similarity):
        run = against(similarity)

        def counted(batches):
            for batch in run(batches):
                made.add(len(batch))
                yield batch

        return counted

    monkeypatch.setattr(neardup, "_against", counting)
    base = words(600)
    rows = [(i, " ".join(base[: 40 * i + 5] + words(30) + base[40 * i + 35 :])) for i in range(15)]
    assert 0.75 < jaccard(shingles(rows[3][1]), shingles(rows[8][1])) < 0.8
    assert kept(spark, rows) == expected(rows) == list(range(15))
    pairs = 15 * 14 // 2
    assert pairs // 2 < made.value < 5 * pairs


def test_buckets_of_one_least_id_are_one(spark):
    rows = [(1, False, 5), (1, False, 6), (2, False, 5), (2, False, 6), (2, False, 7), (3, True, 6), (3, True, 8), (4, False, 9), (5, True, 9)]
    stars = neardup.star_pairs(spark.createDataFrame(rows, "bucket long, hot boolean, id long"))
    assert sorted(map(tuple, stars.collect())) == [(5, 6), (5, 7), (6, 8)]
    assert sorted(map(tuple, neardup.by_least(stars).collect())) == [(5, 5), (5, 6), (5, 7), (6, 6), (6, 8)]


@pytest.mark.parametrize("part, times", [(20, 9), (20, 6), (10, 5)])
def test_repeats_do_not_count(spark, part, times):
    rows = []
    for pair in range(20):
        base = words(200)
        passage = base[: 200 // part]
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(passage * times + base[200 // part :]))]
    assert expected(rows) == [2 * i for i in range(20)]
    assert kept(spark, rows) == expected(rows)


@pytest.mark.parametrize("n, most, sample", [(200, 5, 4000), (150, 4, 0)])
def test_four_hundred_near_copies(spark, monkeypatch, n, most, sample):
    """Of one text, a few words replaced in each; with and without late shingles."""
    monkeypatch.setattr(neardup, "SAMPLE", sample)
    base, rows = words(n), []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(n), rng.randint(1, most)):
            copy[at] = words(1)[0]
        rows.append((i, " ".join(copy)))
    assert 1 < len(expected(rows)) < 200
    assert kept(spark, rows) == expected(rows)


def test_common_passage(spark, monkeypatch):
    """Texts that share a passage and little else, among them pairs of near copies; small blocks and rounds."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "FIRST", 4)
    passage, rows = words(80), []
    for i in range(0, 200, 2):
        own = words(rng.randint(5, 60))
        rows += [(i, " ".join(passage + own)), (i + 1, " ".join(passage + own + words(rng.randint(1, 25))))]
    assert kept(spark, rows) == expected(rows)


def test_any_order_shares_a_key():
    g = np.random.default_rng(4)
    for _ in range(2000):
        n = int(g.integers(1, 60))
        a = int(g.integers(0, n * 0.2 + 1e-9 + 1))
        b = int(g.integers(0, max(0, (n - a) / 0.8 - n) + 1e-9 + 1))
        pool = g.integers(0, 2**64, n + b, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[a:])
        late = np.sort(g.choice(pool, int(g.integers(0, n + b)), replace=False))
        if n - a >= 0.8 * (n + b):
            (p, _), (q, _) = neardup.in_order(x, late), neardup.in_order(y, late)
            assert set(neardup.keys(p, 0.8).tolist()) & set(neardup.keys(q, 0.8).tolist())


def test_stars_over_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 6), (1, 9), (2, 1), (3, 2), (3, 7), (3, 8), (3, 9), (3, 11), (4, 3)]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]]), pa.array([r[1] for r in rows[i : i + size]])], names=["bucket", "id"]) for i in range(0, len(rows), size)]
        got = [(r["a"], r["b"]) for batch in neardup._stars(iter(batches)) for r in batch.to_pylist()]
        assert got == [(5, 6), (5, 9), (2, 7), (2, 8), (2, 9), (2, 11)]


def test_rows_that_share_an_id(spark):
    """The row that stays has the text that the id stands for; columns with names of the operator's own."""
    base = [" ".join(words(60)) for _ in range(4)]
    rows = [(1, base[0], "x", 1), (1, base[1], "y", 2), (1, base[1], "y", 2), (2, base[2], "z", 3), (3, base[3], "z", 4), (3, base[3], "w", 5), (None, base[0], "n", 6), (None, base[0], "n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, lot int")
    first = sorted(map(tuple, neardup.keep_one(df).collect()), key=str)
    again = sorted(map(tuple, neardup.keep_one(df.repartition(7)).collect()), key=str)
    assert first == again
    least = min(base[:2], key=lambda t: neardup._key(t.encode().lower()))
    assert [r[1] for r in first if r[0] == 1] == [least]
    assert sorted(str(r[0]) for r in first) == ["1", "2", "3", "None", "None"]
