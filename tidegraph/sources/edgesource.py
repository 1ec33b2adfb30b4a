"""``format("edgefiles")``: folders of binary edge records as a Spark data source, to read, to write and to replay.

Records have 8, 12 or 16 bytes (option ``record``, default 8). A write is a job whose tasks put down files
of their own; the driver then lists those of finished tasks in a manifest, one small file, and only files
that a manifest lists are read. So a task that dies, is tried again or runs twice leaves nothing that is
read, and nothing has to be renamed. A folder without a manifest (from elsewhere) is read as it is.

Reading: a task takes a range of whole records; a schema with fewer columns decodes those alone.
Replaying: the same records as a stream in the order of the files' names, ``buffer`` records a batch (the
last one has the rest). Offsets count records. The end of a batch is noted under ``progress`` when the
batch is planned, before any row of it is read, so that a query that starts anew goes on where its own
log ends and takes no record twice. ``ahead`` batches are planned at a time; with ``numbered`` a column ``batch``
tells them apart, from 0 in what was planned at once, and deleted records are rows of nulls.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Little-endian records by their size in bytes; 16 has a gap before the weight.
RECORDS = {
    8: np.dtype([("src", "<u4"), ("dst", "<u4")]),
    12: np.dtype([("src", "<u4"), ("dst", "<u4"), ("weight", "<f4")]),
    16: np.dtype({"names": ["src", "dst", "weight"], "formats": ["<u4", "<u4", "<f4"], "offsets": [0, 4, 12], "itemsize": 16}),
}
#: Both ends of a record that has been deleted.
TOMBSTONE = 2**32 - 1
SPLIT = 64 << 20
AT_ONCE = 1 << 20
MANIFEST = "_manifest-"
#: Names that Hadoop gives to file systems which Arrow knows under another one.
KNOWN_AS = {"s3a": "s3", "s3n": "s3"}
COLUMNS = {"src": "long", "dst": "long", "weight": "double"}


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{KNOWN_AS.get(scheme, scheme)}{mark}{rest}")


def schema_of(record: int) -> str:
    return ", ".join(f"{n} {COLUMNS[n]}" for n in RECORDS[record].names)


def decode(data: bytes | pa.Buffer, record: int, columns: list[str], keep_deleted: bool = False) -> pa.RecordBatch:
    """The wanted columns of whole records."""
    rows = np.frombuffer(data, RECORDS[record])
    if not keep_deleted:
        rows = rows[~((rows["src"] == TOMBSTONE) & (rows["dst"] == TOMBSTONE))]
    return pa.RecordBatch.from_arrays([pa.array(rows[n].astype(np.float64 if n == "weight" else np.int64)) for n in columns], names=columns)


def _listed(system: pafs.FileSystem, base: str) -> list[pafs.FileInfo]:
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path)


def _manifests(system: pafs.FileSystem, base: str) -> list[str]:
    return [f.path for f in _listed(system, base) if f.base_name.startswith(MANIFEST)]


def files_of(path: str, record: int) -> list[tuple[str, int]]:
    """Path and size of the files that count, in the order of their names."""
    system, base = open_filesystem(path)
    info = system.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        plain = [f for f in _listed(system, base) if not f.base_name.startswith(("_", "."))]
        if manifests := _manifests(system, base):
            named = set()
            for m in manifests:
                with system.open_input_stream(m) as source:
                    named.update(source.read().decode().split("\n"))
            if gone := named - {f.base_name for f in plain} - {""}:
                raise FileNotFoundError(f"listed but not there: {min(gone)}")
            plain = [f for f in plain if f.base_name in named]
        found = plain
    if odd := [f.path for f in found if f.size % record]:
        raise ValueError(f"not whole records of {record} bytes: {odd[0]}")
    return [(f.path, f.size) for f in found]


@dataclass
class Split(InputPartition):
    file: str
    begin: int
    end: int
    number: int = 0


class EdgeReader(DataSourceReader):
    def __init__(self, path: str, record: int, columns: list[str], keep_deleted: bool):
        if missing := [c for c in columns if c not in RECORDS[record].names]:
            raise ValueError(f"records of {record} bytes have no {missing[0]}")
        self.path, self.record, self.columns, self.keep_deleted = path, record, columns, keep_deleted

    def partitions(self) -> list[Split]:
        step = SPLIT // self.record * self.record
        return [Split(f, a, min(n, a + step)) for f, n in files_of(self.path, self.record) for a in range(0, n, step)] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.begin == split.end:
            return
        system, _ = open_filesystem(self.path)
        with system.open_input_file(split.file) as source:
            for x in range(split.begin, split.end, AT_ONCE * self.record):
                data = source.read_at(min(split.end, x + AT_ONCE * self.record) - x, x)
                yield decode(data, self.record, self.columns, self.keep_deleted)


class EdgeReplay(EdgeReader, DataSourceStreamReader):
    """Offsets are numbers of records over all files, deleted ones included."""

    def __init__(self, path: str, record: int, columns: list[str], keep_deleted: bool, buffer: int, progress: str, ahead: int = 1):
        super().__init__(path, record, [c for c in columns if c != "batch"], keep_deleted)
        self.buffer, self.progress, self.ahead, self.wanted = buffer, progress, ahead, columns
        system, base = open_filesystem(progress)
        self.planned = max((int(f.base_name) for f in _listed(system, base) if f.base_name.isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"record": 0}

    def latestOffset(self) -> dict:
        total = sum(n for _, n in files_of(self.path, self.record)) // self.record
        return {"record": max(self.planned, min(total, self.planned + self.buffer * self.ahead))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        system, base = open_filesystem(self.progress)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{end['record']:020d}") as out:
            out.write(b"")
        self.planned = max(self.planned, end["record"])
        step, at, splits = SPLIT // self.record * self.record, 0, []
        for file, n in files_of(self.path, self.record):
            first, last = max(0, start["record"] * self.record - at), min(n, end["record"] * self.record - at)
            splits += [Split(file, a, min(last, a + step), (at + a) // self.record - start["record"]) for a in range(first, last, step)]
            at += n
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if "batch" not in self.wanted:
            yield from super().read(split)
            return
        plain, number = EdgeReader(self.path, self.record, ["src", "dst", *(c for c in self.columns if c == "weight")], True), split.number
        for rows in plain.read(split):
            src, dst = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            gone, held = (src == TOMBSTONE) & (dst == TOMBSTONE), dict(zip(rows.schema.names, rows.columns))
            held |= {c: pa.array(held[c].to_numpy(), mask=gone) for c in held}
            held["batch"] = pa.array((number + np.arange(len(src))) // self.buffer)
            number += len(src)
            yield pa.RecordBatch.from_arrays([held[c] for c in self.wanted], names=self.wanted)

    def commit(self, end: dict) -> None:
        """Older notes are not needed once a batch is whole."""
        system, base = open_filesystem(self.progress)
        for f in _listed(system, base):
            if f.base_name.isdigit() and int(f.base_name) < end["record"]:
                system.delete_file(f.path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class EdgeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, record: int, columns: list[str], overwrite: bool):
        if missing := [c for c in RECORDS[record].names if c not in columns]:
            raise ValueError(f"records of {record} bytes need {missing[0]}")
        self.path, self.record, self.overwrite, self.job = path, record, overwrite, uuid.uuid4().hex
        system, base = open_filesystem(path)
        self.before = [f.base_name for f in _listed(system, base) if not f.base_name.startswith(("_", "."))] if not _manifests(system, base) else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, base = open_filesystem(self.path)
        system.create_dir(base, recursive=True)
        kind, task = RECORDS[self.record], TaskContext.get()
        name, out = f"part-{task.partitionId():06d}-{self.job}-{task.taskAttemptId()}.bin", None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, kind)
            for n in kind.names:
                values = np.asarray(batch.column(batch.schema.get_field_index(n)))
                if n != "weight" and (batch.column(batch.schema.get_field_index(n)).null_count or values.min() < 0 or values.max() > TOMBSTONE):
                    raise ValueError(f"{n} does not fit a record: ids are numbers from 0 to {TOMBSTONE}")
                rows[n] = values
            out = out or system.open_output_stream(f"{base}/{name}", compression=None)
            out.write(rows.tobytes())
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = open_filesystem(self.path)
        system.create_dir(base, recursive=True)
        names = [m.file for m in messages if m and m.file] + ([] if self.overwrite else self.before)
        older = [f.path for f in _listed(system, base) if not f.base_name.startswith(".")] if self.overwrite else []
        with system.open_output_stream(f"{base}/.{self.job}") as out:
            out.write("\n".join(sorted(names)).encode())
        system.move(f"{base}/.{self.job}", f"{base}/{MANIFEST}{self.job}")
        for path in sorted(older, key=lambda p: MANIFEST not in p):  # what says that old files count goes first
            if path.rsplit("/", 1)[-1] not in names:
                system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = open_filesystem(self.path)
        for f in _listed(system, base):
            if self.job in f.base_name:
                system.delete_file(f.path)


class EdgeFiles(DataSource):
    """Options: ``path``; ``record``; ``keepDeleted``; for streams ``buffer`` (records a batch), ``ahead``, ``numbered`` and ``progress`` (a folder of the query's own)."""

    @classmethod
    def name(cls) -> str:
        return "edgefiles"

    def _given(self) -> tuple[str, int, bool]:
        record = int(self.options.get("record", 8))
        if record not in RECORDS:
            raise ValueError(f"no records of {record} bytes: {', '.join(map(str, RECORDS))}")
        return self.options["path"], record, self.options.get("keepDeleted", "false").lower() == "true"

    def schema(self) -> str:
        return schema_of(self._given()[1]) + (", batch long" if self.options.get("numbered", "false").lower() == "true" else "")

    def reader(self, schema) -> EdgeReader:
        path, record, keep = self._given()
        return EdgeReader(path, record, schema.names, keep)

    def streamReader(self, schema) -> EdgeReplay:
        path, record, keep = self._given()
        buffer = int(self.options.get("buffer", AT_ONCE))
        if buffer < 1:
            raise ValueError("a batch has at least one record")
        ahead = int(self.options.get("ahead", 1))
        if ahead < 1:
            raise ValueError("at least one batch is planned at a time")
        if "progress" not in self.options:
            raise ValueError("name a folder for the query's progress")
        return EdgeReplay(path, record, schema.names, keep, buffer, self.options["progress"], ahead)

    def writer(self, schema, overwrite: bool) -> EdgeWriter:
        path, record, _ = self._given()
        return EdgeWriter(path, record, schema.names, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format from now on."""
    spark.dataSource.register(EdgeFiles)
    return spark
