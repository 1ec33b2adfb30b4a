"""SimHash near-duplicates by covering locality-sensitive hashing (operator 6).

``covering_masks(bits, radius)`` gives each bit a vector of ``radius + 1`` bits; for every non-zero
vector v the mask of table v keeps the bits whose own vector has an odd product with v. Any ``radius``
bits have vectors that some v is orthogonal to, so that its table leaves all of them out: every pair
of fingerprints within the radius meets in some table.

Only distinct fingerprints enter the tables (documents with equal ones are linked already). A bucket
never lists its pairs: its members within the radius are joined to one another by a search that looks
only at members not reached yet, and the bucket gives a row for each member that has joined another.
Buckets over ``HOT`` members are dealt anew first, by a further cover that keeps about half of the bits
that their table left free, and so on: once at most log2(``HOT``) bits are left free no bucket can hold
more, so this ends after a few covers, and no task ever searches more than ``HOT`` fingerprints at once.
Links form components through contraction rounds on Spark, each cut by a written table.

Defined results: a null or empty text has no shingle and fingerprint zero; a text of any length is read
whole (one over a chunk's bytes alone); repeated rows stay, a row each, and ties (bits that half of the
hashes have) are 0; a null ``doc_id`` never names a component unless no other id can; an empty table gives
an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import union
from .storage import drop, materialise
from .tokenize import chunks

#: Members from which on a bucket is dealt anew.
HOT = 4096
#: Hashes turned into bits at once: 64 bytes each.
AT_ONCE = 1 << 17


def covering_masks(bits: int, radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of the bits that a table keeps. Any ``radius`` bits are all left out by one of them."""
    size = 1 << radius + 1
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of all words if there are fewer."""
    import xxhash

    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    starts, stops = (ends - sizes)[:n].tolist(), (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(seed)), np.uint64, n)


def simhash(hashes: list[np.ndarray]) -> np.ndarray:
    """A 64-bit fingerprint for each list: a bit is set where over half of the hashes have it."""
    counts = np.zeros((len(hashes), 64), np.int64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
    for a in range(0, len(flat), AT_ONCE):
        own = owner[a : a + AT_ONCE]
        bits = np.unpackbits(flat[a : a + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint ``fp`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                fp = simhash([shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower(), words, seed) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def reached(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (least of its component, member) that join all of ``fps`` that lie within the radius of each other."""
    left, roots, members = np.unique(fps), [], []
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        group = [edge]
        while len(edge) and len(left):
            hit = np.zeros(len(left), bool)
            for x in edge:  # what has been reached is not looked at again
                hit |= np.bitwise_count(left ^ x) <= radius
                if hit.all():
                    break
            edge, left = left[hit], left[~hit]
            group.append(edge)
        if len(group) > 1 and len(group[1]):
            group = np.concatenate(group)
            root = group.min()
            roots.append(np.full(len(group) - 1, root))
            members.append(group[group != root])
    none = np.empty(0, np.uint64)
    return np.concatenate([*roots, none]), np.concatenate([*members, none])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _rotated(mask: int, by: int) -> int:
    """The same cover with its vectors dealt to other bits."""
    return (mask >> by | mask << 64 - by) & (1 << 64) - 1


def _bucket_links(radius: int, hot: int):
    """Rows (mask, key, fp) in the order of mask and key become links (a, b); members of a bucket over ``hot`` pass with its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = np.empty((3, 0), np.int64), None
        for batch in batches:
            rows = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns])], axis=1)
            if passing is not None:
                same = ((rows[0] == passing[0]) & (rows[1] == passing[1])).cumprod().sum()
                yield passed(rows[:, :same])
                rows = rows[:, same:]
                if not rows.shape[1]:
                    continue  # the bucket may go on in the next batch
                passing = None
            cut = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            whole = cut[-1] if len(cut) else 0
            yield from linked(rows[:, :whole], np.concatenate([[0], cut]))
            held = rows[:, whole:]
            if held.shape[1] > hot:
                passing = tuple(held[:2, 0])
                yield passed(held)
                held = held[:, :0]
        if held.shape[1]:
            yield from linked(held, np.array([0, held.shape[1]]))

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0])], names=["a", "b", "mask"])

    def linked(rows: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, sizes = rows[2].view(np.uint64), np.diff(cut)
        pair = cut[:-1][sizes == 2]  # most buckets: all at once
        close = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius]
        roots, members = [np.minimum(fps[close], fps[close + 1])], [np.maximum(fps[close], fps[close + 1])]
        for a, n in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if n > hot:
                yield passed(rows[:, a : a + n])
                continue
            r, m = reached(fps[a : a + n], radius)
            roots.append(r)
            members.append(m)
        a, b = (pa.array(np.concatenate(x).view(np.int64)) for x in (roots, members))
        yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int64())], names=["a", "b", "mask"])

    return run


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b), a row each, with the same components as all pairs of distinct ``fp`` within ``radius`` bits."""
    masks, found, level = covering_masks(64, radius), [], 0
    rows = classes.select("fp", F.lit(0).cast("long").alias("had"))
    while True:
        cover = [F.col("had").bitwiseOR(F.lit(_signed(_rotated(m, 7 * level % 64)))) for m in masks]
        dealt = rows.select("fp", F.explode(F.array(*cover)).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        if level:  # tables of other buckets may have become one
            dealt = dealt.distinct()
        dealt = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key")
        made = materialise(dealt.mapInArrow(_bucket_links(radius, HOT), "a long, b long, mask long"), "links")
        found.append(made.where("b is not null"))
        again = made.where("b is null")
        if again.isEmpty():
            return union(found).select("a", "b").distinct()
        rows, level = again.select(F.col("a").alias("fp"), F.col("mask").alias("had")), level + 1


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that links (a, b) lead to, for every node that has a link.

    Each round points a node at its least neighbour, follows the pointers twice and contracts the
    links; the nodes that still have links at least halve in number.
    """
    edges = materialise(edges.where("a <> b").select("a", "b"), "edges")
    nodes = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p")).select("n", F.least("n", "p").alias("p"))
        top = up.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        up = materialise(up.join(top, "p", "left").select("n", F.coalesce("pp", "p").alias("p")), "pointers")
        a, b = (up.select(F.col("n").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        left = materialise(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        drop(edges)
        edges = left
        if nodes is None:
            nodes = materialise(up.select(F.col("n").alias("node"), F.col("p").alias("root")), "nodes")
        else:
            moved = materialise(nodes.join(up, nodes.root == up.n, "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
            drop(nodes)
            nodes = moved
        drop(up)
    return nodes if nodes is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def label(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint and component_id (the least doc_id reachable) of every document."""
    prints = materialise(fingerprints(docs, words, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(prints.select("fp").distinct(), radius))
    known = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    owner = known.join(least, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
