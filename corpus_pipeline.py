"""The training-data pipeline: quality rules, near-duplicates, mixing, packing, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import mixing, neardup, packing, quality
from tidegraph.llm.queries import BYTE_VOCABULARY, vocabulary
from tidegraph.llm.storage import materialise


#: Target shares of the domains' tokens in the mix, and how much the good ones grow to reach them (their documents are taken once or more); no domain grows more.
SHARES = {"poor": 0.05, "poor_toxic": 0.005, "good": 0.915, "good_toxic": 0.03}
GROWTH = 1.25
#: Bytes of text and word pieces that a packing worker holds at once: stages before it have left their share of memory behind.
AT_ONCE, REMEMBERED = 4 << 20, 300_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity of 0.8 or more)."""
    return neardup.keep_one(docs, words=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken as often as the mix of domains asks for."""
    return mixing.take(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARES, anchor_rate=GROWTH, most=GROWTH)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    rows = packing.pack_documents(docs, vocabulary(BYTE_VOCABULARY), capacity=1024, end_id=2, at_once=AT_ONCE, remembered=REMEMBERED)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]

#: Expectation-maximisation, SimHash and the vocabulary are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
