"""Graphs derived from the star-schema tables, each with its twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .graph import Graph

PART_EDGES_SQL = """
    e AS (SELECT src, dst, min(w) AS weight FROM (
        SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst, l_quantity AS w
        FROM lineitem WHERE l_quantity <= 8) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
    v AS (SELECT p_partkey AS id FROM part)"""
SYMMETRIC_SQL = PART_EDGES_SQL + """,
    s AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY src, dst)"""
COPURCHASE_SQL = """
    c AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey)
          WHERE a.l_partkey <> b.l_partkey AND a.l_quantity <= 15 AND b.l_quantity <= 15),
    v AS (SELECT p_partkey AS id FROM part)"""
WHOLE_COPURCHASE_SQL = """
    c AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey)
          WHERE a.l_partkey <> b.l_partkey),
    v AS (SELECT p_partkey AS id FROM part)"""
RATINGS_SQL = """
    n AS (SELECT count(*) AS parts FROM part),
    r AS (SELECT l_partkey AS src, l_suppkey + parts AS dst, avg(l_quantity) AS weight FROM lineitem, n GROUP BY l_partkey, l_suppkey, parts)"""
EVENT_EDGES_SQL = """
    t AS (SELECT CAST(ts AS DATE) AS day, user_id AS a, 1000000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS b FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def part_edges(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that follow each other in an order, for small quantities; the weight is the least quantity."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity <= 8").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("w"))
    edges = pairs.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").alias("weight"))
    return Graph(edges, parts(spark, sf_dir), "part_edges")


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order, both directions."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity <= 15").select("l_orderkey", "l_partkey")
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("src")).join(lines.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey")
    return Graph(pairs.where("src <> dst").select("src", "dst").distinct(), parts(spark, sf_dir), "copurchase")


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, member: the parts of every order, whatever the quantity. Those of one order are joined by edges in ``WHOLE_COPURCHASE_SQL``."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("member"))


#: Rows of a task that groups a table by keys with few rows each.
ROWS = 1 << 20


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over tasks of about ``ROWS``, so that what a task holds does not grow with the table. Few rows stay as they are."""
    n = rows.count()
    return rows.repartition(max(-(-n // ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if n > ROWS else rows


def ratings(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers (numbered after the parts) with the mean quantity between them."""
    n = parts(spark, sf_dir).count()
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    lines = dealt(lines, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.avg("l_quantity").alias("weight"))
    edges = lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst"), "weight")
    return Graph(edges, name="ratings")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, a, b: users and what their events are about."""
    key = F.regexp_extract("props", "([0-9]+)", 1).cast("long") + 1000000
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("a"), key.alias("b"))
