"""Noisy-channel restoring against all ways through a lattice, and scores on held-out and on altered texts."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from tidegraph.llm import toxicity

rng = random.Random(12)
PLAIN = "the house stands on a hill and the river runs below it while people walk along in the morning sun".split()
RUDE = ["idiot", "moron", "stupid", "trash"]
TABLES = "/root/testdata/sf0.1"


def text(rude=0, n=40):
    words = rng.choices(PLAIN, k=n)
    for _ in range(rude):
        words.insert(rng.randint(0, len(words)), rng.choice(RUDE))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    return toxicity.language_model(toxicity.trigrams([text(i % 3) for i in range(300)])).tolist()


def test_trigrams_are_those_of_words():
    counts = toxicity.trigrams(["Ab c", "", "é"]).reshape(64, 64, 64)
    a, b, c, e = (int(toxicity.SYMBOL[ord(x)]) for x in "abcé")
    there = {(0, 0, a), (0, a, b), (a, b, 0), (0, 0, c), (0, c, 0), (0, 0, e), (0, e, 0)}
    assert {tuple(map(int, x)) for x in np.argwhere(counts)} == there and counts.sum() == 7


@pytest.mark.parametrize("place", ["1d10t", "mm00r0n", "s t u p i d", "tr@$h", "iidioott", "s.t-up1d", "l3 4", "ßx0"])
def test_viterbi_finds_the_best_way(model, place):
    steps = [*toxicity.lattice(place), [(" ", 0.0)]]
    symbol = lambda c: 0 if c == " " else int(toxicity.SYMBOL[ord(c)])

    def worth(ways):
        total, a, b = sum(cost for _, cost in ways), 0, 0
        for c in map(symbol, "".join(out for out, _ in ways)):
            if c or b:
                total += model[(a << 6 | b) << 6 | c]
            a, b = (b, c) if c else (0, 0)
        return total

    best = max(itertools.product(*steps), key=worth)
    got = toxicity.restore(place, model)
    tied = {" ".join("".join(o for o, _ in w).split()) for w in itertools.product(*steps) if abs(worth(w) - worth(best)) < 1e-9}
    assert got in tied


def test_what_is_meant(model):
    for written, meant in {"1d10t": "idiot", "m0r0n": "moron", "s t u p i d": "stupid", "s.t.u.p.i.d": "stupid", "7r4sh": "trash", "idiooooot": "idiot", "mor0n": "moron", "t-r-a-s-h": "trash"}.items():
        assert toxicity.restore(written, model) == meant
    known = {}
    texts = ["You 1d10t\nand m o r o n, yes", "", "All is WELL", "a$$$ THE!! x", "plain\n\nlines", "7r4sh"]
    assert toxicity.restored(texts, model, known) == ["you idiot\nand moron yes", "", "all is well", "a$$$ the!! x", "plain\n\nlines", "trash"]
    assert known["1d10t"] == "idiot" and toxicity.restored(["none"], model, known) == ["none"]


def test_chosen_codes_are_found_once_a_text():
    texts = ["idiot idiot", "an idiom", "", "x"]
    doc, code = toxicity.grams(texts)
    assert len(code) == len(doc) and set(code[doc == 0]) & set(code[doc == 1]) and not (doc == 2).any()
    chosen = toxicity.Chosen(np.unique(code))
    pairs = set(zip(*(x.tolist() for x in chosen.within(texts))))
    assert pairs == {(int(d), int(np.searchsorted(chosen.codes, c))) for d, c in zip(doc, code)}


def altered_form(word):
    return rng.choice([word.replace("i", "1").replace("o", "0"), " ".join(word), ".".join(word), word.replace("a", "@").replace("s", "$").replace("t", "7", 1), word[:2] + word[2] * 5 + word[3:]])


def corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        rude = i % 5 == 0
        rows.append((i, text(2 if rude else 0)))
        labels.append((i, int(rude)))
    return rows, labels


def test_altered_texts_score_as_plain_ones(spark):
    rows, labels = corpus(spark)
    hidden = [(10_000 + i, " ".join(altered_form(w) if w in RUDE else w for w in text(2).split())) for i in range(60)]
    clean = [(20_000 + i, text() + rng.choice([" 100 l0ud", " 1 2 3", " a b c", " see 3rd row!!", " ###"])) for i in range(60)]
    odd = [(30_000, None), (30_001, ""), (None, rows[0][1]), (0, rows[0][1]), (30_002, "Idiot " * 200_000), (30_003, "é　" * 1000), (30_004, rows[0][1])]
    docs = spark.createDataFrame(rows + hidden + clean + odd, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS toxic", "2 AS SCORE", "'x' AS lang")
    known = spark.createDataFrame(labels + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.score(docs, known).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        got.setdefault(r.doc_id, []).append(r.score)
    assert sum(got[i][0] >= 0.5 for i, _ in hidden) >= 57 and not any(got[i][0] >= 0.5 for i, _ in clean)
    assert all((got[i][0] >= 0.5) == bool(t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0)
    assert len(got[0]) == 2 and got[0][0] == got[0][1] == got[None][0] == got[30_004][0] and got[30_000] == got[30_001] and got[30_002][0] >= 0.5 > got[30_003][0]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, labels.where("false")).collect()] == [0, 0]
    assert all(r.score > 0.99 for r in toxicity.score(docs, labels).collect())
    assert toxicity.score(docs.where("false"), labels).count() == 0


def test_labels_that_are_held_out_are_not_read(spark):
    rows, labels = corpus(spark, 200)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (toxicity.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rows = toxicity.score(spark.read.parquet(f"{TABLES}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.96 * len(rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.01 * len(rows)  # clean documents are left alone
