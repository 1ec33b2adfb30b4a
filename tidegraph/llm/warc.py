"""WARC archives, read through their index (operator 3).

Writing: every row becomes a record, a gzip member of its own, and each task writes one archive. The
index (file, offset, length, url, digest, ...) is the result of the job that writes, so it lists only
what finished tasks wrote. Reading: the selected index rows are dealt by ranges of (file, offset),
sorted, and ranges that lie close together are fetched by one read.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is a response
and the others are revisits that refer to it; their block keeps the headers, with the payload's length.
Which payloads repeat is learnt from digests alone; tables of up to some 48 MB of repeated ones are handed
to the tasks that have the payloads, larger ones are joined by digest.

A record's id is its own even where rows repeat; pages are named by a field of their own. A url stands in
its header as it is, but for line ends, which no header can hold: these are percent-encoded there, and the
exact url follows in a field of its own (as it does in the index).

Defined results: a null payload is empty; a null url has no header and is read as null; repeated
rows (same id, same payload) that hold the largest id are responses each; a null id is never referred
to and revisits a record that has an id; payloads of any length are one record, read whole by one task;
an empty table gives no archive and no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import drop, materialise, open_filesystem, work_path

INDEX = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Gaps up to this many bytes are read over, and no read spans more, unless one record does.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of archive that a reading task takes.
TASK = 16 << 20
#: Bytes of repeated digests that are handed to every task, and what one takes beside its url.
HANDED, ENTRY = 48 << 20, 160
#: Fixed value of the WARC 1.1 standard.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Fields of our own: pages by their ids, and the exact url where its header had to change it.
PAGE, REFERS, EXACT = "Page-ID", "Refers-To-Page-ID", "Target-URI-Base64"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, there: str | None, date: str, name: uuid.UUID) -> bytes:
    """One WARC record, not compressed. A revisit (with ``refers_to`` and the url there) has the headers alone in its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name.urn}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
        if one_line(url) != url:
            head.append(f"{EXACT}: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    head += ["Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To-Date: {date}", f"{REFERS}: {refers_to}"]
        head += [] if there is None else [f"WARC-Refers-To-Target-URI: {one_line(there)}"]
    block = http + payload if refers_to is None else http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(url: str) -> str:
    """A url for a header: line ends are percent-encoded, all else stays."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> dict:
    """What a record says; its payload is checked against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name] = value.removeprefix(" ")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(fields[x]) if x in fields else None
    url = base64.b64decode(fields[EXACT]).decode("utf-8", "surrogatepass") if EXACT in fields else fields.get("WARC-Target-URI")
    return {"page_id": number(PAGE), "url": url, "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": number(REFERS), "payload": None if revisit else payload}


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    return rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})


def repeated_payloads(rows: DataFrame, least: int = 1000) -> DataFrame:
    """digest, last (page_id, url): a row for each payload that comes more than once. No payload is moved to learn this."""
    keys = rows.where(F.col("size") >= least).select("digest", "page_id", "url")
    return keys.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")


def with_revisits(rows: DataFrame, repeated: DataFrame, least: int = 1000) -> DataFrame:
    """Adds refers_to (null: a response) and the url there. ``repeated`` is a table: what of it is small enough goes to the payloads, which stay where they are; a larger one is joined by a shuffle."""
    told = repeated.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("last.url")), F.lit(0)).alias("urls")).first()
    rows = rows.join(F.broadcast(repeated) if told["n"] * ENTRY + told["urls"] <= HANDED else repeated, "digest", "left")
    last = F.col("last.page_id")
    revisits = last.isNotNull() & ~last.eqNullSafe(F.col("page_id")) & (F.col("size") >= least)
    return rows.withColumns({"refers_to": F.when(revisits, last), "there": F.when(revisits, F.col("last.url"))}).drop("last")


def write_archives(pages: DataFrame, folder: str, least: int = 1000, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Writes the records of all pages and returns their index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        system.create_dir(base, recursive=True)
        salt = uuid.uuid4()
        file, out, offset = f"records-{TaskContext.get().partitionId():06d}-{salt.hex}.warc.gz", None, 0
        for batch in batches:
            index = []
            for n in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to, there = (c[n].as_py() for c in batch.columns)
                if out is None:
                    out = system.open_output_stream(f"{base}/{file}", compression=None)
                member = gzip.compress(record(page_id, url, html, digest, size, refers_to, there, date, uuid.uuid5(salt, str(offset))), 5, mtime=0)
                out.write(member)
                index.append((page_id, url, "response" if refers_to is None else "revisit", digest, size, file, offset, len(member)))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index) if index else [()] * 8, INDEX_TYPES)], names=INDEX_NAMES)
        if out is not None:
            out.close()

    rows = with_digests(pages)
    repeated = materialise(repeated_payloads(rows, least), "warc-repeated")
    rows = with_revisits(rows, repeated, least).select("page_id", "url", "html", "digest", "size", "refers_to", "there")
    index = materialise(rows.mapInArrow(write, INDEX), "warc-index")
    drop(repeated)
    return index


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
RECORD_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads (file, begin, end, records) that cover sorted (file, offset, length), neighbours together."""
    have = None
    for file, offset, length in rows:
        if have and have[0] == file and offset - have[2] <= GAP and offset + length - have[1] <= SPAN:
            have[3].append((offset, length))
            have = (file, have[1], max(have[2], offset + length), have[3])
        else:
            if have:
                yield have
            have = (file, offset, offset + length, [(offset, length)])
    if have:
        yield have


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the ``selected`` index rows point to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        name, source = None, None
        for batch in batches:
            for file, begin, end, own in ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if file != name:
                    name, source = file, system.open_input_file(f"{base}/{file}")
                data = source.read_at(end - begin, begin)
                found = [parse(gzip.decompress(data[o - begin : o - begin + n])) for o, n in own]
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(RECORD_NAMES, RECORD_TYPES)], names=RECORD_NAMES)

    total = selected.agg(F.sum("length")).first()[0] or 0
    rows = selected.select("file", "offset", "length").repartitionByRange(-(-total // TASK) or 1, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, RECORDS)


def archive_and_read(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads every record back."""
    folder = work_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, least), folder, payloads=False).drop("payload")
