"""Every stage of the pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

rng = random.Random(11)
COMMON = "the of and to in is that a for on".split()
POOL = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8))) for _ in range(800)]


def clean(n=120):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.35 else rng.choice(POOL) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, clean()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # exact copies
    for i in range(20):  # near copies
        words = rows[20 + i][1].split()
        words[60] = "altered"
        rows.append((330 + i, " ".join(words)))
    rows += [(360 + i, " ".join(f"{w}***" for w in clean().split())) for i in range(30)]  # junk
    rows += [(400 + i, clean() + " vileword") for i in range(30)]  # toxic
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 360 <= i < 390), int(i >= 400)) for i, _ in rows if i % 10 < 8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = corpus_pipeline.good_quality(spark, docs, corpus)
    assert ids(good) == [i for i in ids(docs) if not 360 <= i < 390]
    single = corpus_pipeline.near_duplicates(spark, good, corpus)
    assert ids(single) == [i for i in ids(good) if not 300 <= i < 360]
    mixed = corpus_pipeline.mixture(spark, single, corpus)
    assert set(range(300)) <= set(ids(mixed))  # clean ones stay
    assert len([i for i in ids(mixed) if i >= 400]) < 25
    for stage in (good, single, mixed):
        assert stage.columns == docs.columns
    rows = corpus_pipeline.packed(spark, mixed, corpus)
    assert rows.agg(F.sum("length")).first()[0] > 0
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert set(range(300)) <= {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixture", "packing"]


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
