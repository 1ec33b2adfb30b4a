"""One document of each group of near copies, by an exact set similarity join of shingles.

Texts with the same words (lower case) are one class, named by its least doc_id. Two classes are near
copies if the Jaccard similarity of their sets of ``words``-word shingles (64-bit hashes) reaches
``similarity``. Near copies form components, and the least doc_id of each stays.

Candidates are texts that share a bucket, of two sorts. The tables of covering locality-sensitive hashing
over the SimHash of the shingle set (operator 6) bring every pair within ``RADIUS`` bits together. A pair
at the least similarity asked for may differ in twenty bits, which no affordable cover reaches, so that a
second sort of bucket is exact on the sets themselves. Let x have n shingles, a of them not in y, and y b
others, with similarity t or more. Then a <= (1 - t) n and b <= (n - a) / t - n. In any order of all
shingles the a + b differing ones leave a + b + 1 gaps, so that of the first a + b + 2 common ones two
stand side by side: they are neighbours in x and in y, within the first 2 a + b + 2 <= 2 (1 - t) n + 2 of
x. So the pairs of neighbours among that many first shingles are the keys of a text, and all near copies
share a key (for t of 0.8 or more and two shingles or more; otherwise single shingles are keys, of which
the first a + 1 <= (1 - t) n + 1 do). Nothing about candidates is left to chance.

The order is that of the hashes, but shingles that many texts of a sample share come last: a passage that
stands in many texts is then no key of texts that have enough of their own. The lemma holds in any order,
so the sample changes the work and not the result.

Buckets with the same least id are one from then on, with the members of all: texts that are alike but not
enough share hundreds of keys, and each pair of them would meet in as many buckets. The rows are then no more
than the pairs of the first round and their least ids.

Pairs of a bucket are checked in rounds: its least id with all others, then about 16 members drawn by a
hash of their ids with all others, then 256, and so on. What a round links is one component from then on,
and pairs within one component are passed over; a bucket ends when all its members are in one component or
have been centres. So a large group of copies of one text takes about one pair for each member, and yet
each pair that shares a bucket is checked, or is in one component, or is ruled out by ``_bounded``. That
bound is exact too: counts of the hashes in ``CELLS`` cells cannot differ by more than the sets do, and with
that many cells they differ by hardly less. A round deals a bucket's members out in blocks of about ``BLOCK``,
each with a copy of the round's centres, of which there are at most about as many. Keys of shingles that many
texts share are never dealt by the key alone: their least ids come from an aggregation.

Defined results: rows that share a doc_id are one document, with the text whose words hash least, and one of
its rows with that text stays; rows with a null doc_id stay as they are; null and empty texts are
copies of each other; texts of any length are read whole; a tie (a similarity right at the limit) is a near
copy; an empty table stays empty; columns pass through as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .simhash import components, covering_masks, shingle_hashes, simhash
from .storage import drop, materialise, unused
from .tokenize import chunks

#: Bits within which the tables of the cover bring fingerprints together.
RADIUS = 4
#: Cells of the counts that rule pairs out, a byte each.
CELLS = 512
#: Centres of the first round after that of the least ids; each later one has ``MORE`` times as many, up to ``BLOCK`` more.
FIRST, MORE, BLOCK = 16, 16, 2048
#: Parts that a bucket of late shingles is dealt to.
SALTS = 64
#: Texts whose shingles are counted for the order, how many of these make a shingle a late one, and late ones at most (8 bytes each).
SAMPLE, OFTEN, LATE = 4000, 4, 500_000
#: Texts up to which those to read are picked by a broadcast (24 bytes each) and not by a shuffle.
BROADCAST_IDS = 200_000
#: Pairs compared at once.
AT_ONCE = 1 << 14
#: Bytes of text handled at once: a worker holds some 30 times as much.
CHUNK = 2 << 20
SLACK = 1e-9


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix."""
    x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(found: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a text by its distinct shingle hashes in the common order. Sets as similar as asked share one."""
    n = len(found)
    if similarity < 0.8:
        return found[: int((1 - similarity) * n + SLACK) + 1]
    if n < 2:
        return found
    head = found[: int(2 * (1 - similarity) * n + SLACK) + 2]
    return _mixed(_mixed(head[:-1]) + head[1:])


def in_order(found: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, int]:
    """Ascending hashes with the ``late`` ones (ascending) at the end, and how many come before them."""
    if not len(late) or not len(found):
        return found, len(found)
    is_late = late[np.minimum(np.searchsorted(late, found), len(late) - 1)] == found
    return np.concatenate([found[~is_late], found[is_late]]), int(len(found) - is_late.sum())


def counted(found: np.ndarray) -> bytes:
    """How many hashes lie in each cell, up to 255."""
    return np.minimum(np.bincount((found >> np.uint64(32)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()


def _bounded(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with cells x, y and sizes n, m can be as similar as asked."""
    apart = np.maximum(np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64), np.abs(n - m))
    return apart <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def _key(text: bytes) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(b" ".join(text.split()))


def _lowered(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts.to_pylist()]


def printed(docs: DataFrame) -> DataFrame:
    """doc_id and the key of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                found = [_key(t) for t in _lowered(batch.column(1).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], names=["doc_id", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, key binary")


def shingled(docs: DataFrame, classes: DataFrame, words: int, made, schema: str) -> DataFrame:
    """``made(ids, sets)`` of the distinct shingle hashes (in order) of the texts of ``classes`` (rep, key), a batch each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                ids, texts, own = (batch.column(c).slice(a, b - a) for c in range(3))
                lowered = _lowered(texts)
                keep = [i for i, (t, k) in enumerate(zip(lowered, own.to_pylist())) if _key(t) == k]  # a doc_id may have more texts
                yield made(ids.take(pa.array(keep, pa.int64())), [np.unique(shingle_hashes(lowered[i], words, 42)) for i in keep])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    few = classes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(classes) if few else classes, "rep").select("rep", "text", "key").mapInArrow(run, schema)


def late_shingles(docs: DataFrame, classes: DataFrame, words: int) -> np.ndarray:
    """Shingles that ``OFTEN`` or more of the sampled classes have, in order."""

    def made(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["shingle"])

    drawn = materialise(classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE), "sample")
    counts = shingled(docs, drawn, words, made, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "shingle").limit(LATE).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _keyed(similarity: float, late):
    """Rows (bucket, hot, id) of texts: the cover's tables of their fingerprints, and their keys; hot ones are made of late shingles."""
    masks = np.array(covering_masks(64, RADIUS), np.uint64)
    salt = _mixed(np.arange(1, len(masks) + 1, dtype=np.uint64))

    def made(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        tables = _mixed((simhash(sets)[:, None] & masks) ^ salt) if sets else np.empty((0, len(masks)), np.uint64)
        own, hot = [], []
        for table, found in zip(tables, sets):
            ordered, early = in_order(found, late.value)
            mine = keys(ordered, similarity)
            own += [table, mine]
            hot += [np.zeros(len(table), bool), np.arange(len(mine)) >= early]
        buckets = np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)
        many = [len(x) for x in own]
        owner = np.repeat(np.asarray(ids), [a + b for a, b in zip(many[::2], many[1::2])])
        return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.concatenate([*hot, np.empty(0, bool)])), pa.array(owner)], names=["bucket", "hot", "id"])

    return made


def _celled(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array([counted(x) for x in sets], pa.binary())], names=["id", "n", "cells"])


def _listed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])
    flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "shingles"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, hot, id) in the order of their bucket, the hot ones and those that share it with another."""
    before = last = None
    for batch in batches:
        bucket, hot = (np.asarray(batch.column(x)) for x in (0, 1))
        if not len(bucket):
            continue
        same = bucket[1:] == bucket[:-1]
        keep = np.append(False, same) | np.append(same, False) | hot
        if last is not None and last[0] == bucket[0]:
            keep[0] = True
            if before is not None:
                yield before
        yield batch.filter(pa.array(keep))
        last, before = (bucket[-1],), None if keep[-1] else batch.slice(len(bucket) - 1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each bucket's first member with the others, from rows (bucket, id) in order; no bucket is held."""
    last = centre = None
    for batch in batches:
        bucket, ids = (np.asarray(c) for c in batch.columns)
        if not len(bucket):
            continue
        first = np.append(True, bucket[1:] != bucket[:-1])
        centres = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
        if last is not None and bucket[0] == last:
            centres[: int(np.argmax(first[1:])) + 1 if first[1:].any() else len(ids)] = centre
        last, centre = bucket[-1], centres[-1]
        own = centres != ids
        a, b = centres[own], ids[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _against(similarity: float):
    """Pairs (a, b) of the centres and the members of each block, from rows (bucket, block, centre, id, root, n, draw, cells) with centres first.

    A pair counts if its components differ, the centre was drawn before the member, and the bound lets them be alike.
    """

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        centre, ids, root, n, draw = (np.asarray(rows.column(x)) for x in ("centre", "id", "root", "n", "draw"))
        k = int(centre.sum())
        if not k or k == len(ids):
            return
        cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        members = np.arange(k, len(ids))
        for i in range(k):
            later = (draw[k:] > draw[i]) | (draw[k:] == draw[i]) & (ids[k:] > ids[i])
            other = members[(root[k:] != root[i]) & later & (np.minimum(n[k:], n[i]) >= similarity * np.maximum(n[k:], n[i]) - 1e-6)]
            if len(other):
                other = other[_bounded(cells[i][None].astype(np.int16), cells[other], n[i], n[other], similarity)]
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[other])), pa.array(np.maximum(ids[i], ids[other]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            bucket, block = (np.asarray(batch.column(x)) for x in (0, 1))
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
                if a == b:
                    continue
                if name is not None and name != (bucket[a], block[a]):
                    yield from compared(pa.Table.from_batches(held).combine_chunks())
                    held = []
                name = (bucket[a], block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from compared(pa.Table.from_batches(held).combine_chunks())

    return run


def _possible(similarity: float):
    """Of rows (a, b, n, cells, m, others) those that the bound lets be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (3, 5))
                ok = _bounded(x, y, np.asarray(part.column(2)), np.asarray(part.column(4)), similarity)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return run


def checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``classes`` whose shingle sets are as similar as asked (a tie is)."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(classes, "rep"), "paired")
    sets = materialise(shingled(docs, ids, words, _listed, "id long, shingles array<long>").dropDuplicates(["id"]), "shingles")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    # |both| >= similarity * |either|, without dividing
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both >= similarity * either).select("a", "b")


def star_pairs(rows: DataFrame) -> DataFrame:
    """Of rows (bucket, hot, id) the pairs (a, b) of each bucket's least id with the others, each pair once."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)
    rows = rows.repartition("bucket", salt).sortWithinPartitions("bucket", "id").mapInArrow(_crowded, "bucket long, hot boolean, id long")
    rows = materialise(rows, "crowded")
    plain = rows.where("not hot").select("bucket", "id")
    stars = plain.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_stars, "a long, b long")
    # a bucket of late shingles may hold a large part of all texts: combined before it is dealt, and split by the join if need be
    hot = rows.where("hot").select("bucket", "id")
    least = hot.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("bucket", "a")
    stars = stars.unionByName(hot.join(least, "bucket").where("id <> a").select("a", F.col("id").alias("b")))
    stars = materialise(stars.distinct(), "stars")
    drop(rows)
    return stars


def by_least(stars: DataFrame) -> DataFrame:
    """Rows (bucket, id) of the buckets that pairs (least id, other) tell of, one for each least id."""
    return stars.select(F.col("a").alias("bucket"), F.col("b").alias("id")).unionByName(stars.select(F.col("a").alias("bucket"), F.col("a").alias("id")).distinct())


def open_members(rest: DataFrame, roots: DataFrame, start: int) -> DataFrame:
    """Of rows (bucket, id, m) those in buckets of several components with members left to be centres; with ``root``."""
    rooted = rest.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "id", "m", F.coalesce("root", "id").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("m").alias("size")).where("low <> high").where(F.col("size") > start).select("bucket")
    return materialise(rooted.join(several, "bucket"), "open")


def links(docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) with the same components as all pairs of ``classes`` (rep, key) that are as similar as asked."""
    late = docs.sparkSession.sparkContext.broadcast(late_shingles(docs, classes, words))
    stars = star_pairs(shingled(docs, classes, words, _keyed(similarity, late), "bucket long, hot boolean, id long"))
    crowded = by_least(stars)
    meeting = materialise(crowded.select(F.col("id").alias("rep")).distinct().join(classes, "rep"), "meeting")
    cells = materialise(shingled(docs, meeting, words, _celled, "id long, n long, cells binary").dropDuplicates(["id"]), "cells")
    one = cells.select(F.col("id").alias("a"), "n", "cells")
    two = cells.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("cells").alias("others"))
    pairs = stars.join(one, "a").join(two, "b").select("a", "b", "n", "cells", "m", "others").mapInArrow(_possible(similarity), "a long, b long")
    tried = materialise(pairs, "pairs")
    found = materialise(checked(tried, docs, classes, words, similarity), "near")
    sizes = crowded.groupBy("bucket").agg(F.count("*").alias("m"))
    rest, start, stop = crowded.join(sizes, "bucket").select("bucket", "id", "m"), 0, FIRST
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("draw")), 11) / F.lit(float(2**53))
    while True:
        still = open_members(rest, components(found), start)
        drop(rest)
        rest = still.select("bucket", "id", "m")
        rest._kept_at = still._kept_at
        if still.isEmpty():
            return found
        rows = still.join(cells, "id").withColumn("draw", draw).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        centres = rows.where((F.col("draw") * F.col("m") >= start) & (F.col("draw") * F.col("m") < stop))
        centres = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("centre", F.lit(True))
        members = rows.where(F.col("draw") * F.col("m") >= start).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")).withColumn("centre", F.lit(False))
        columns = ["bucket", "block", "centre", "id", "root", "n", "draw", "cells"]
        dealt = centres.select(*columns).unionByName(members.select(*columns)).repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("centre"))
        pairs = dealt.mapInArrow(_against(similarity), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = tried.unionByName(pairs)
        found = found.unionByName(materialise(checked(pairs, docs, classes, words, similarity), "near"))
        start, stop = stop, min(stop * MORE, stop + BLOCK)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with all their columns, one of each group of near copies."""
    named = materialise(printed(docs).groupBy("doc_id").agg(F.min("key").alias("key"), F.count("*").alias("n")), "named")
    classes = materialise(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(docs, classes, words, similarity))
    kept = classes.select(F.col("rep").alias("kept_id")).join(roots.where("node <> root").select(F.col("node").alias("kept_id")), "kept_id", "left_anti")
    kept = materialise(kept, "kept")
    rows = docs.where("doc_id is not null")
    stay = rows.join(kept.hint("merge"), rows.doc_id == kept.kept_id, "left_semi")  # the same at every size
    repeated = named.where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("key").alias("own_key"))
    if not repeated.isEmpty():
        stay = stay.join(repeated, stay.doc_id == repeated.again_id, "left_anti").unionByName(_one_row(rows, kept, repeated))
    return stay.unionByName(docs.where("doc_id is null"))


def _one_row(rows: DataFrame, kept: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of the rows of each kept id that repeats, the one with the id's text (of several the one whose columns hash least)."""
    again = repeated.join(kept, repeated.again_id == kept.kept_id, "left_semi")
    key, at = unused("key", rows.columns), rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(at), CHUNK):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_key(t) for t in _lowered(part.column(at))], pa.binary())], names=[*part.schema.names, key])

    found = rows.join(again, rows.doc_id == again.again_id, "left_semi").mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(key, T.BinaryType())]))
    lot = unused("lot", found.columns)
    found = found.withColumn(lot, F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))
    found = found.join(again, (found.doc_id == again.again_id) & (found[key] == again.own_key), "left_semi")
    best = found.groupBy(F.col("doc_id").alias("best_id")).agg(F.min(lot).alias("least"))
    return found.join(best, (found.doc_id == best.best_id) & (found[lot] == best.least), "left_semi").drop(key, lot).dropDuplicates(["doc_id"])
