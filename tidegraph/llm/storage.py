"""Working files in the folder that driver and executors share: the library's own tables, and file systems."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from ..plans.lineage import cut, drop, remove, shared_dir, work_path

__all__ = ["drop", "materialise", "open_filesystem", "remove", "shared_dir", "unused", "work_path"]

#: Bytes of an Arrow batch that a Python worker gets at most while a table is made: it and its executor hold several at once.
BATCH, SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, which also cuts its lineage."""
    conf = df.sparkSession.conf
    before = conf.get(SETTING)
    if 0 < int(before.rstrip("b")) <= BATCH:
        return cut(df, label)
    conf.set(SETTING, str(BATCH))
    try:
        return cut(df, label)
    finally:
        conf.set(SETTING, before)


def unused(name: str, columns: list[str]) -> str:
    """A name like ``name`` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a URI, for use on driver and executors alike."""
    return pafs.FileSystem.from_uri(uri)
