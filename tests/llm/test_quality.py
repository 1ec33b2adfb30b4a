"""Quality rules: counts of very long texts, and expectation-maximisation against plain loops over documents."""

import collections
import itertools
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tidegraph.llm import quality

rng = random.Random(5)


def test_more_distinct_words_than_a_field_holds():
    n = 2**21 + 50
    text = " ".join(map(str, range(n)))
    counts, read = quality.measure(pa.array([text, "a b c d a b c", text + " 0 1 2"]))
    assert counts["n_repeat_words"].tolist() == [0, 6, 6]
    assert counts["n_words"].tolist() == [n, 7, n + 3]
    assert read["distinct"][0] == 1 and read["distinct"][2] == n / (n + 3)


def plain_em(votes, rounds):
    """The posterior of every document, all sums written out."""
    n, names = len(votes), [r[0] for r in quality.RULES]
    groups = [[names.index(x) for x in g] for g in quality.GROUPS]
    weight = quality.PRIOR_WEIGHT * n
    joint = lambda own, g: tuple(own[j] for j in g)
    p = [1 / (1 + math.exp(-(1 + sum((s > 0) - 2 * (s < 0) for s in (sum(joint(own, g)) for g in groups))))) for own in votes]
    for _ in range(rounds):
        share = (sum(p) + 0.8 * weight) / (n + weight)
        chance = {}
        for kind, part in (("good", p), ("poor", [1 - x for x in p])):
            poor, good = quality.PRIOR[kind]
            of = {0: 1 - poor - good, 1: good, -1: poor}
            for i, g in enumerate(groups):
                for vote in itertools.product((0, 1, -1), repeat=len(g)):
                    seen = sum(x for x, own in zip(part, votes) if joint(own, g) == vote)
                    chance[kind, i, vote] = (seen + weight * math.prod(of[v] for v in vote)) / (sum(part) + weight)
        new = []
        for own in votes:
            good, poor = share, 1 - share
            for i, g in enumerate(groups):
                good, poor = good * chance["good", i, joint(own, g)], poor * chance["poor", i, joint(own, g)]
            new.append(good / (good + poor))
        if max(abs(a - b) for a, b in zip(new, p)) < 1e-9:
            break
        p = new
    return new


def fitted(votes):
    """The posterior of each pattern of votes."""
    patterns = sorted(set(map(tuple, votes)))
    found = np.array(patterns, np.int8)
    count = collections.Counter(map(tuple, votes))
    return dict(zip(patterns, quality.posterior(found, quality.fit(found, np.array([count[x] for x in patterns], float)))))


def test_every_rule_is_in_one_group():
    assert sorted(itertools.chain(*quality.GROUPS)) == sorted(r[0] for r in quality.RULES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expectation_maximisation(seed):
    draw = random.Random(seed)
    votes = []
    for _ in range(150):
        good = draw.random() < 0.75
        votes.append([draw.choices([1, 0, -1], [0.5, 0.49, 0.01] if good else [0.2, 0.5, 0.3])[0] for _ in quality.RULES])
    got, want = fitted(votes), plain_em(votes, 400)
    assert max(abs(got[tuple(v)] - w) for v, w in zip(votes, want)) < 1e-5


def planted(n, says):
    """Votes on n documents, a fifth of them poor: ``says(name, poor)`` is a rule's vote."""
    return [([says(r[0], i % 5 == 0) for r in quality.RULES], i % 5 == 0) for i in range(n)]


def test_a_mistaken_rule_is_overruled():
    """The rule on words says poor of every third document, whatever it is; the others are mostly right."""
    draw = random.Random(4)

    def says(name, poor):
        if name == "words":
            return -1 if draw.random() < 0.33 else 1
        return draw.choices([1, 0, -1], [0.05, 0.35, 0.6] if poor else [0.6, 0.38, 0.02])[0]

    rows = planted(3000, says)
    got, words = fitted([v for v, _ in rows]), [r[0] for r in quality.RULES].index("words")
    alone = [v for v, poor in rows if not poor and v[words] < 0 and min(v[:words]) >= 0]
    assert len(alone) > 300 and all(got[tuple(v)] > 0.5 for v in alone)
    assert sum((got[tuple(v)] < 0.5) == poor for v, poor in rows) > 0.98 * len(rows)


def test_rules_that_repeat_each_other_count_once():
    """One rule repeats another of its group: beside a clear good vote of the rest, the two weigh as one does."""
    draw = random.Random(6)
    names = [r[0] for r in quality.RULES]
    first, again = names.index("repeats"), names.index("distinct")

    def votes(copied):
        out = []
        for i in range(4000):
            poor = i % 5 == 0
            own = [0] * len(names)
            for name in ("symbols", "repeats", "common", "word_length", "exclaims"):
                own[names.index(name)] = draw.choices([1, -1], [0.25, 0.75] if poor else [0.85, 0.15])[0]
            own[again] = own[first] if copied else 0
            out.append(own)
        return out

    def weight(copied):
        """What the group's poor vote takes off the log odds."""
        rows = votes(copied)
        found = np.array(sorted(set(map(tuple, rows))), np.int8)
        count = collections.Counter(map(tuple, rows))
        tables, _ = quality.fit(found, np.array([count[tuple(x.tolist())] for x in found], float))
        own = [0] * len(names)
        own[first], own[again] = -1, -1 if copied else 0
        g = [i for i, x in enumerate(quality.GROUPS) if "repeats" in x][0]
        return tables[g][quality.grouped(np.array([own], np.int8))[0, g]]

    assert abs(weight(True) - weight(False)) < 0.5 * abs(weight(False))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_posterior_decides_otherwise_than_all_must_pass(spark):
    """Documents that a rule calls poor are kept where the rest says good, and labels agree."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.measured(docs).where("exists(votes, v -> v < 0)").select("doc_id")
    kept = quality.judge(docs).where("kept").join(stats, "doc_id").join(labels, "doc_id", "left").select("doc_id", labels["quality"].alias("label")).collect()
    assert len(kept) > 20 and all(r.label in (None, 1) for r in kept)


def test_stage_keeps_what_the_query_keeps(spark):
    """Columns named as those that the stage adds, nulls, repeated rows and a very long text."""
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    texts = [None, "", " ".join(word() for _ in range(200_000))] + [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["### " * 80] * 4
    rows = [(None if i == 7 else i // 2, t, "clash", i % 2 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, Failed boolean")
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    key = lambda i: -1 if i is None else i
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(key(r.doc_id) for r in quality.judge(docs).where("kept").collect())
