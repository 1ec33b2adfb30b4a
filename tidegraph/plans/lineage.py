"""Keeping the results of an iteration as tables in the shared folder.

What a superstep leaves is written once and read back, so plans stay short and any executor may be
lost: nothing but files is needed to go on. Tables that a later one has replaced are dropped as soon as
that one is whole, the others when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set here only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = kept.get() if kept.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidegraph-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean_up)
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up() -> None:
    """Removes the working files of this driver. Frames that read them end with it."""
    while _made:
        path, spark = _made.popitem()
        try:
            remove(spark, path)
        except Exception:  # the session may have ended; the cluster's own retention then applies
            continue


def cut(df: DataFrame, label: str = "state", by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` (in folders ``by`` some columns) and reads it back: what follows starts from the files."""
    path = work_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def counted(df: DataFrame, label: str = "state", by: list[str] | None = None) -> tuple[DataFrame, int]:
    """As ``cut``, with the number of rows, which is counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), label, by)
    return out, seen.get["n"]


def observed(df: DataFrame, aggregates: dict[str, Column], label: str = "state") -> tuple[DataFrame, dict]:
    """As ``cut``, with aggregates over the rows, which are taken as they are written."""
    if not aggregates:
        return cut(df, label), {}
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(n) for n, c in aggregates.items())), label)
    return out, {n: seen.get[n] for n in aggregates}


def drop(*frames: DataFrame) -> None:
    """Removes the tables of frames that ``cut`` made and that nothing reads any more. Other frames are left alone."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path in _made:
            remove(_made.pop(path), path)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
