"""A Merkle manifest of a dataset, with a broadcast upper tree (operator 13).

A row is a leaf: the SHA-256 of its fields, each as byte count, ``:`` and value (null: ``-``). The leaves of a
source, by ``doc_id``, are a tree of runs of three; the roots of the sources, null first and then by their
UTF-8 bytes, are a tree of the same kind above them.

Leaves get their places by ranges of (source, doc_id), so that a source of any size is spread over many
tasks. Aligned blocks of ``BLOCK`` leaves are whole subtrees: each is reduced to one node by one task, and what
is left, a ``BLOCK``-th, is reduced again in the same way until at most ``TOP`` nodes remain. The driver
builds that top tree and hands every node its way to the root, the siblings of each level; these are broadcast
(their number is bounded by ``TOP``), and the executors finish the proof of every row of a block and fold its
leaf, or what a tampered text would make of it, up to the root.

Defined results: a null field is ``-`` and an empty one ``0:``; texts of any length are hashed whole; rows
with the same source and ``doc_id`` are leaves of their own, in the order of their digests (equal ones are
interchangeable); a null ``doc_id`` comes first in its source and is never tampered with; a tampered null text
stays null, and one without a line feed stays as it is and verifies; a lone leaf is its subroot, a lone
subroot the root, and a proof without siblings the hash of nothing; an empty table gives an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sorting import numbered
from .storage import materialise

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Children of a node; leaves of a block (a power of it); nodes that the driver takes to build the top tree.
ARITY, BLOCK, TOP = 3, 3**7, 3**9


def digest(parts: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields of a row."""
    said = []
    for c in fields.values():
        text = c.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The levels of the tree over ``nodes``, the lowest first, up to one node or by ``most`` levels."""
    out = [nodes]
    while (len(out[-1]) > 1) if most is None else (len(out) <= most):
        below = out[-1]
        out.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def path(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The siblings to the left and to the right of a node's way up, joined, level by level."""
    out = []
    for level in tree[:-1]:
        low = at - at % ARITY
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + ARITY])))
        at //= ARITY
    return out


def fold(node: str, way: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in way:
        node = digest((left, node, right))
    return node


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and the leaf of the text that tampering leaves (null: untouched)."""
    fields = {c: F.col(c) for c in FIELDS}
    ids = F.col("doc_id").cast("long")
    if tampered is None:
        even = F.crc32(ids.cast("string").cast("binary")) % 2 == 0
        tampered = F.when(even & F.col("text").cast("string").contains("\n"), F.translate(F.col("text").cast("string"), "\n", ""))
    rows = docs.select(*FIELDS).withColumn("changed", tampered)
    other = F.when(F.col("changed").isNotNull(), leaf(fields | {"text": F.col("changed")}))
    return rows.select(ids.alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(fields).alias("leaf"), other.alias("tampered"))


def placed(rows: DataFrame) -> DataFrame:
    """The leaves as nodes: tree (the source), ``pos`` (the place in it), hash, and ``size``, the leaves of the tree. Places come from ranges and their counts."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()]
    # the row's number in the input parts even equal rows, which may change places
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("range", F.shiftright("at", 33))
    own = Window.partitionBy("source")
    sizes = ranged.groupBy("source", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = sizes.withColumn("before", F.sum("n").over(own.orderBy("range")) - F.col("n")).withColumn("size", F.sum("n").over(own))
    sizes = sizes.select(F.col("source").alias("tree"), F.col("range").alias("r"), "first", "before", "size")
    out = ranged.join(sizes, ranged.source.eqNullSafe(sizes.tree) & (ranged.range == sizes.r))
    return out.select("doc_id", "tree", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), F.col("leaf").alias("hash"), "tampered", "size")


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    """The blocks of nodes (tree, pos), each whole in one task, in their order."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of a block at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        keys = list(zip(columns["tree"], columns["block"]))
        a = 0
        while a < len(keys):
            b = bisect.bisect_right(range(len(keys)), 0, a, key=lambda i: keys[i] != keys[a])
            if held and (held["tree"][0], held["block"][0]) != keys[a]:
                yield held
                held = {}
            held = {name: held.get(name, []) + x[a:b] for name, x in columns.items()}
            a = b
    if held:
        yield held


def _levels(rows: dict[str, list], block: int) -> list[list[str]]:
    """The levels over a block's nodes: as many as a block has, or up to one node where the tree has no other block."""
    return levels(rows["hash"], len(levels([""] * block)) - 1 if rows["size"][0] > block else None)


def _reduced(nodes: DataFrame, block: int) -> DataFrame:
    """tree, pos, hash, size: the nodes that blocks are reduced to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            top = _levels(rows, block)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([rows["tree"][0]], pa.string()), pa.array([rows["block"][0]], pa.int64()), pa.array([top]), pa.array([-(-rows["size"][0] // block)], pa.int64())], names=["tree", "pos", "hash", "size"])

    return _blocked(nodes.select("tree", "pos", "hash", "size"), block).mapInArrow(run, "tree string, pos long, hash string, size long")


def _beside(nodes: DataFrame, upper: DataFrame, few: bool, block: int) -> DataFrame:
    """The blocks of nodes; the first row of each has the way of the block's node up, and the top (and root) there."""
    nodes = nodes.withColumn("above", F.floor(F.col("pos") / block).cast("long"))
    ways = upper.select(F.col("tree").alias("t"), F.col("pos").alias("b"), F.struct(*(c for c in upper.columns if c not in ("tree", "pos"))).alias("up"))
    joined = nodes.join(F.broadcast(ways) if few else ways, nodes.tree.eqNullSafe(ways.t) & (nodes.above == ways.b))
    return _blocked(joined.withColumn("up", F.when(F.col("pos") == F.col("above") * block, F.col("up"))).drop("t", "b", "above"), block)


WAY = "array<struct<left: string, right: string>>"


def climb(nodes: DataFrame, block: int = BLOCK, top: int = TOP) -> tuple[DataFrame, bool]:
    """For every node (tree, pos, hash, size): tree, pos, top (the root of its tree) and way (the siblings of each level up to it); and whether these are at most ``top`` rows."""
    spark = nodes.sparkSession
    if nodes.limit(top + 1).count() <= top:
        trees: dict[str | None, list[str]] = {}
        for r in sorted(nodes.collect(), key=lambda r: r.pos):  # at most ``top`` rows
            trees.setdefault(r.tree, []).append(r.hash)
        built = {name: levels(hashes) for name, hashes in trees.items()}
        rows = [(name, i, tree[-1][0], path(tree, i)) for name, tree in built.items() for i in range(len(tree[0]))]
        return spark.createDataFrame(rows, f"tree string, pos long, top string, way {WAY}"), True
    if nodes.agg(F.max("size")).first()[0] == 1:
        return nodes.select("tree", "pos", F.col("hash").alias("top"), F.array().cast(WAY).alias("way")), False
    upper, few = climb(materialise(_reduced(nodes, block), "nodes"), block, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            tree, up, n = _levels(rows, block), rows["up"][0], len(rows["hash"])
            above = [(x["left"], x["right"]) for x in up["way"]]
            ways = [[{"left": a, "right": b} for a, b in path(tree, i) + above] for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["tree"], pa.string()), pa.array(rows["pos"], pa.int64()), pa.array([up["top"]] * n), pa.array(ways, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], names=["tree", "pos", "top", "way"])

    return materialise(_beside(nodes, upper, few, block).mapInArrow(run, f"tree string, pos long, top string, way {WAY}"), "ways"), False


def manifest(docs: DataFrame, tampered: Column | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; ``tampered``: an expression for a changed text (null: unchanged), by default the contract's."""
    rows = materialise(placed(leaves(docs, tampered)), "placed")
    nodes = materialise(_reduced(rows, block), "nodes")
    within, few = climb(nodes, block, top)
    subroots = numbered(within.where("pos = 0").select("tree", "top"), "tree", name="place")
    subroots = materialise(subroots.select(F.lit("").alias("tree"), F.col("place").alias("pos"), F.col("top").alias("hash"), F.col("tree").alias("name")), "subroots")
    n = subroots.count()
    over, few_trees = climb(subroots.withColumn("size", F.lit(n).cast("long")), block, top)
    over = over.select(F.col("pos").alias("p"), F.col("top").alias("root"), F.col("way").alias("on"))
    over = subroots.select("name", "pos").join(F.broadcast(over) if few_trees else over, F.col("pos") == F.col("p")).select("name", "root", "on")
    upper = within.join(F.broadcast(over) if few_trees else over, F.col("tree").eqNullSafe(F.col("name"))).select("tree", "pos", "top", "root", F.concat("way", "on").alias("way"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            tree, up, n = _levels(rows, block), rows["up"][0], len(rows["hash"])
            above, proofs, folded = [(x["left"], x["right"]) for x in up["way"]], [], []
            rest = "".join(a + b for a, b in above)
            for i, (own, other) in enumerate(zip(rows["hash"], rows["tampered"])):
                way = path(tree, i)
                proofs.append(digest([a + b for a, b in way] + [rest]))
                folded.append(fold(own if other is None else other, way + above))
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), *(pa.array(x, pa.string()) for x in (rows["hash"], [up["top"]] * n, [up["root"]] * n, proofs, folded))], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    proofs = _beside(rows, upper, few, block).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
