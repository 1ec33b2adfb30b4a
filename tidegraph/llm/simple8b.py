"""Token-id files in Simple-8b word-aligned coding (operator 5).

A file is the magic followed by segments, all little-endian::

    segment  u32 documents, u32 blocks, u64 ids, u64 words
             i64 doc_id[documents], u8 has_id[documents], u64 n_ids[documents]
             u64 first_word[blocks], u64 word[words]

Ids run through the documents of a segment in blocks of ``BLOCK``. The top four bits of a word select
how many ids of which width its other 60 bits hold. Selector 0 is the escape: a word of zero, then the
id itself in the next word. Ids that need it have a bit over the 60th, so no such word looks like an
escape, and all words of a segment can be decoded at once from the offsets of its blocks.

Defined results: a null text is empty (its end id alone); a text of any length is written whole, in one
segment; repeated rows are written each, ties of ids in the order of a hash of their texts (then of the
input); a null ``doc_id`` comes first and is read back as null; an empty table gives no file and no row;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import materialise, open_filesystem, work_path
from .tokenize import chunks, encoder

MAGIC = b"TGS8B-01"
BLOCK = 256
#: Fixed values of the code: ids in a word and bits of each, for selectors 1 to 14.
PACKINGS = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]
COUNTS = np.array([1, *(n for n, _ in PACKINGS), 1], np.int64)
#: Files that a task reads, one after the other.
FILES = 3
HEAD = struct.Struct("<IIQQ")


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if ids.size and ids.max() < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    bits = np.zeros(ids.shape, np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = rest >= np.uint64(1) << np.uint64(step)
        bits[more] += np.uint8(step)
        rest[more] >>= np.uint64(step)
    return bits + (rest > 0).astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector that packs most ids from there on. Past a block's end fits all."""
    rows, width = bits.shape
    longest = COUNTS.max()
    power = {1: np.concatenate([bits, np.zeros((rows, longest), np.uint8)], axis=1)}
    while (p := max(power)) * 2 <= longest:
        m = power[p]
        power[2 * p] = np.concatenate([np.maximum(m[:, :-p], m[:, p:]), m[:, -p:]], axis=1)
    best = np.zeros(bits.shape, np.uint8)
    for code, (n, most) in enumerate(PACKINGS, 1):
        p = 1 << n.bit_length() - 1
        widest = np.maximum(power[p][:, :width], power[p][:, n - p : n - p + width])
        best[widest <= most] = code
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block. All blocks are packed side by side."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    padded = np.zeros((blocks, BLOCK), np.uint64)
    padded.reshape(-1)[: len(ids)] = ids
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(ids) - (blocks - 1) * BLOCK
    best = _selectors(_widths(padded))
    place, words, taken = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), []
    active = np.arange(blocks)
    while len(active):
        code = best[active, place[active]]
        taken.append((active, place[active], words[active], code))
        place[active] += COUNTS[code]
        words[active] += 1 + (code == 0)
        active = active[place[active] < sizes[active]]
    block, start, word, code = (np.concatenate(x) for x in zip(*taken))
    first = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    at = first[block] + word
    flat = np.concatenate([padded.reshape(-1), np.zeros(int(COUNTS.max()), np.uint64)])
    begin = block * BLOCK + start
    rest = BLOCK - start  # ids of the next block do not belong to this word
    for c, (n, bits) in enumerate(PACKINGS, 1):
        if len(own := np.flatnonzero(code == c)):
            packed = np.full(len(own), np.uint64(c) << np.uint64(60))
            for k in range(n):
                value = flat[begin[own] + k]
                if k:
                    value[rest[own] <= k] = 0
                packed |= value << np.uint64(k * bits)
            out[at[own]] = packed
    escaped = code == 0
    out[at[escaped] + 1] = flat[begin[escaped]]
    return out, first.astype(np.uint64)


def decode(words: np.ndarray, first: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks."""
    code = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[1:] = code[:-1] == 0
    many = np.where(raw | (code == 0), 0, COUNTS[code])
    many[raw] = 1
    before = np.cumsum(many) - many
    in_block = np.diff(np.append(first.astype(np.int64), len(words)))
    block = np.repeat(np.arange(len(first)), in_block)
    start = block * BLOCK + before - before[first.astype(np.int64)][block] if len(first) else before
    out = np.zeros(len(first) * BLOCK + int(COUNTS.max()), np.uint64)
    end = (block + 1) * BLOCK
    for c, (n, bits) in enumerate(PACKINGS, 1):
        if len(own := np.flatnonzero((code == c) & ~raw)):
            mask = np.uint64((1 << bits) - 1)
            for k in range(n):
                at = start[own] + k
                held = at < end[own]
                out[at[held]] = words[own[held]] >> np.uint64(k * bits) & mask
    out[start[raw]] = words[raw]
    return out[:n_ids]


def write_segment(out: BinaryIO, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
    words, first = encode(ids)
    has = np.asarray(doc_ids.is_valid()).astype(np.uint8)
    out.write(HEAD.pack(len(doc_ids), len(first), len(ids), len(words)))
    for part, kind in ((np.asarray(doc_ids.fill_null(0)), "<i8"), (has, "u1"), (sizes, "<u8"), (first, "<u8"), (words, "<u8")):
        out.write(np.ascontiguousarray(part, kind).tobytes())


def read_segments(source: BinaryIO) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc ids, their numbers of ids and the ids, for each segment of a file."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    take = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind)
    while head := source.read(HEAD.size):
        documents, blocks, n_ids, n_words = HEAD.unpack(head)
        doc_ids, has, sizes, first, words = take("<i8", documents), take("u1", documents), take("<u8", documents), take("<u8", blocks), take("<u8", n_words)
        yield pa.array(doc_ids, pa.int64(), mask=has == 0), sizes.astype(np.int64), decode(words, first, n_ids)


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and each document's number of ids."""
    return np.insert(ids, at[1:], end_id), np.diff(at) + 1


def write_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Writes the ids of all documents in ascending ``doc_id`` order: a file for each range of ids.

    Returns the manifest (part, file, n_docs, n_ids), a row for each file; only files that it lists
    count, so that what a lost or repeated task left behind is never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        system, base = open_filesystem(folder)
        system.create_dir(base, recursive=True)
        file, out, n_docs, n_ids = f"ids-{part:06d}-{uuid.uuid4().hex}.s8b", None, 0, 0
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                if out is None:
                    out = system.open_output_stream(f"{base}/{file}")
                    out.write(MAGIC)
                ids, sizes = with_ends(*enc.encode(batch.column(1).slice(a, b - a)), end_id)
                write_segment(out, batch.column(0).slice(a, b - a), sizes, ids)
                n_docs, n_ids = n_docs + len(sizes), n_ids + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]  # an id that many rows share is divided
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long").repartition(1), "ids-manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    rows = manifest.select("part", "file", "n_ids").orderBy("part").collect()  # a row for each file
    spark, base, starts = manifest.sparkSession, 0, []
    for r in rows:
        starts.append((r.file, base))
        base += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_filesystem(folder)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_stream(f"{top}/{file}") as source:
                    for doc_ids, sizes, ids in read_segments(source):
                        ends = np.cumsum(sizes)
                        view = memoryview(ids.astype("<u4")).cast("B")
                        crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += len(ids)

    files = spark.createDataFrame(starts, "file string, start long").repartition(-(-len(starts) // FILES) or 1)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes the files in the shared folder and reads them back."""
    folder = work_path(docs.sparkSession, "ids")
    return read_files(write_files(docs, vocabulary, end_id, folder), folder)
