"""Edge lists in binary and text files, and the descriptor beside them."""

from __future__ import annotations

import configparser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import uniform
from ..graph import GraphMeta
from .edgesource import RECORDS, EdgeFiles, decode, files_of, open_filesystem, registered, schema_of


def read_binary(spark: SparkSession, path: str, record: int = 8, keep_deleted: bool = False) -> DataFrame:
    """Edges of a file, or of the files of a folder. Each task reads a range of whole records.

    Paths that Arrow cannot open (``viewfs`` and what else only Hadoop knows) go through Spark's own readers.
    """
    if not _arrow_opens(path):
        return read_through_hadoop(spark, path, record, keep_deleted)
    files_of(path, record)  # says at once what is wrong with them
    return registered(spark).read.format(EdgeFiles.name()).option("record", record).option("keepDeleted", keep_deleted).load(path)


def read_through_hadoop(spark: SparkSession, path: str, record: int = 8, keep_deleted: bool = False) -> DataFrame:
    """As ``read_binary`` over any file system that Hadoop has, in its splits. Every file whose name starts with neither _ nor . is read, and manifests are not looked at."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.listStatus(at):
        if not found.getPath().getName().startswith(("_", ".")) and found.getLen() % record:
            raise ValueError(f"not whole records of {record} bytes: {found.getPath()}")
    records = spark.sparkContext._jsc.binaryRecords(path, record).rdd()
    rows = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    names = list(RECORDS[record].names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode(b"".join(batch.column(0).to_pylist()), record, names, keep_deleted)

    return rows.mapInArrow(unpack, schema_of(record))


def _arrow_opens(path: str) -> bool:
    try:
        open_filesystem(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def write_binary(edges: DataFrame, folder: str, record: int = 8) -> list[str]:
    """Adds a file for each partition and returns the paths of all that count (of finished tasks)."""
    rows = edges.select(*RECORDS[record].names)
    registered(edges.sparkSession)
    rows.write.format(EdgeFiles.name()).option("record", record).mode("append").save(folder)
    return [path for path, _ in files_of(folder, record)]


def write_in_order(edges: DataFrame, folder: str, *order: Column | str, record: int = 8) -> None:
    """As ``write_binary``, so that the files put one after the other by their names are in the order."""
    ranged = edges.repartitionByRange(*order).sortWithinPartitions(*order).select(*RECORDS[record].names)
    registered(edges.sparkSession)
    ranged.write.format(EdgeFiles.name()).option("record", record).mode("append").save(folder)


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    where = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")
    lines = spark.read.text(path).select(F.trim("value").alias("line"), where)
    return lines.where((F.col("line") != "") & ~F.col("line").startswith(comment))


def _hashed_weight(seed: int = 1):
    return uniform(F.lit(seed), F.col("src"), F.col("dst")).alias("weight")


def read_matrix_market(spark: SparkSession, path: str, weighted: bool = False) -> tuple[DataFrame, int]:
    """Edges (ids from 0) and the number of vertices of a coordinate file. A pattern's weights come from a hash of the ends."""
    lines = _lines(spark, path, "%").withColumn("t", F.split("line", r"\s+"))
    sized = lines if weighted else lines.where(F.size("t") == 3)
    header = sized.agg(F.min(F.struct("at", "line", "t")).alias("h")).first()["h"]
    if header is None:
        raise ValueError("no size line")
    body = lines.where(F.col("line") != header["line"]).select("t")
    again = lines.where(F.col("line") == header["line"]).count() - 1  # edges that read like the size line: as many stay as there are
    if again > 0:
        body = body.unionByName(spark.range(again).select(F.array(*map(F.lit, header["t"])).alias("t")))
    edges = body.select((F.col("t")[0].cast("long") - 1).alias("src"), (F.col("t")[1].cast("long") - 1).alias("dst"), "t")
    edges = edges.select("src", "dst", F.col("t")[2].cast("double").alias("weight")) if weighted else edges.select("src", "dst", _hashed_weight())
    return edges, max(int(header["t"][0]), int(header["t"][1]))


def _pairs(lines: DataFrame, sep: str, base: int) -> DataFrame:
    t = F.split("line", sep)
    return lines.select((t[0].cast("long") - base).alias("src"), (t[1].cast("long") - base).alias("dst"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def read_snap(spark: SparkSession, path: str, both_ways: bool = True) -> DataFrame:
    """Tab-separated pairs, # comments; the reverse of every edge is added."""
    edges = _pairs(_lines(spark, path, "#"), r"\s+", 0)
    return (_both_ways(edges) if both_ways else edges).select("src", "dst", _hashed_weight())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated pairs of ids from 1, % comments."""
    return _pairs(_lines(spark, path, "%"), r"\s+", 1).select("src", "dst", _hashed_weight())


def read_adjacency(spark: SparkSession, path: str, both_ways: bool = True) -> DataFrame:
    """Lines of a source, the number of its targets, and these; the reverse of every edge is added."""
    t = F.split("line", r"\s+")
    rows = _lines(spark, path, "#").select(t[0].cast("long").alias("src"), F.slice(t, F.lit(3), F.greatest(t[1].cast("int"), F.lit(0))).alias("to"))
    edges = rows.select("src", F.explode("to").alias("dst")).select("src", F.col("dst").cast("long").alias("dst"))
    return (_both_ways(edges) if both_ways else edges).select("src", "dst", _hashed_weight())


def read_ratings(spark: SparkSession, path: str, n_movies: int = 17770) -> DataFrame:
    """Files of a movie each (``1:``, then user,rating,date): movies from 0, users renumbered after them; the weight is the rating."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*$", 1).cast("long").alias("movie"))
    t = F.split("line", ",")
    rows = lines.where(F.size(t) >= 2).select((F.col("movie") - 1).alias("src"), t[0].cast("long").alias("user"), t[1].cast("double").alias("weight"))
    from ..operators.sorting import numbered

    users = numbered(rows.select("user").distinct(), "user")
    return rows.join(users, "user").select("src", (F.col("row") + n_movies).alias("dst"), "weight")


def write_matrix_market(edges: DataFrame, folder: str, meta: GraphMeta) -> None:
    """Text parts that make a coordinate file when put together in the order of their names. Ids start from 1."""
    values = [(F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), *([F.col("weight").cast("string")] if "weight" in edges.columns else [])]
    kind = "real" if "weight" in edges.columns else "pattern"
    head = f"%%MatrixMarket matrix coordinate {kind} general\n{meta.n_vertices} {meta.n_vertices} {meta.n_edges}"
    header = edges.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    header.unionByName(edges.select(F.concat_ws(" ", *values).alias("value"))).write.text(folder)


def write_pairs(edges: DataFrame, folder: str) -> None:
    """Tab-separated pairs."""
    edges.select("src", "dst").write.csv(folder, sep="\t")


def _hadoop(path: str):
    """Hadoop's file system of a path, and the path, in the driver."""
    context = SparkSession.active().sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def read_descriptor(path: str) -> GraphMeta:
    """An INI file with name, type (1 weighted, 2 not), vertices and edges. The counts are the file's claim."""
    found = configparser.ConfigParser()
    found.read_string(SparkSession.active().read.text(path, wholetext=True).first()["value"])
    g = found["graph"]
    return GraphMeta(g["name"], g.getint("type") == 1, g.getint("vertices"), g.getint("edges"))


def write_descriptor(meta: GraphMeta, path: str) -> None:
    system, at = _hadoop(path)
    out = system.create(at)
    out.write(f"[graph]\nname={meta.name}\ntype={1 if meta.weighted else 2}\nvertices={meta.n_vertices}\nedges={meta.n_edges}\n".encode())
    out.close()
