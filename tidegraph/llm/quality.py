"""Quality rules by weak supervision (operator 9).

Each rule reads a text's counts and votes for good, for poor, or abstains. Expectation-maximisation
over the votes of all documents (their patterns, at most 3^rules rows whatever the corpus) estimates
how often each rule is right on good and on poor documents and how many are good; the verdict is the
posterior probability that a document is good, given its votes. No labels are used. Some rules are
deliberately sensitive (few words): what they say is worth what it proves to be worth beside the
others, and a poor vote of theirs is overruled where it is not. Rules that read nearly the same thing are a
group, whose votes count jointly (a table over their patterns), so that one fault is not counted twice.

Defined results: a null or empty text has no words; rules that need words abstain on it; a text of any
length is counted whole (one over ``CHUNK`` bytes alone); repeated rows are judged each; a tie (a
posterior right at the limit) keeps a document; a null ``doc_id`` is kept; an empty table gives an empty
result; extra columns, whatever their names, are ignored by ``judge`` and passed on by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .storage import materialise, unused
from .tokenize import chunks

#: Bytes of text handled at once: a worker holds some 30 times as much.
CHUNK = 2 << 20
BLANK, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Frequent words of four languages.
COMMON = "the of and to in is that a for on with la de le les et que des du en un el los y por con der die und das von zu den ein mit ist".split()
#: Rule: what it reads, poor from, good from. Poor is the upper end unless it lies below good or ``low``; None: it never votes so.
RULES = [
    ("symbols", 0.2, None, "high"),
    ("repeats", 0.35, None, "high"),
    ("dup_lines", 0.35, None, "high"),
    ("capitals", 0.5, None, "high"),
    ("exclaims", 0.3, None, "high"),
    ("word_length", 9.0, 6.5, "high"),
    ("lettered", 0.7, None, "low"),
    ("distinct", 0.25, None, "low"),
    ("common", 0.02, 0.08, "low"),
    ("words", 80.0, 200.0, "low"),
]
#: Rules that are told by much the same words: signs in place of letters, repetition, the look of words.
GROUPS = [("symbols", "lettered"), ("repeats", "dup_lines", "distinct"), ("capitals",), ("exclaims",), ("word_length",), ("common",), ("words",)]
#: Belief before any votes are seen: how often a rule says poor and good of a good and of a poor document,
#: with the weight of this share of the documents.
PRIOR = {"good": (0.1, 0.4), "poor": (0.3, 0.2)}
PRIOR_WEIGHT = 0.002


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The counts of every text, and what the rules read (nan: nothing to read)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    has = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(has).dictionary_encode()
    doc, codes, values = owner.filter(has).to_numpy().astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    words = np.bincount(doc, minlength=n)
    total = lambda flag: np.bincount(doc, weights=flag.to_numpy(zero_copy_only=False).astype(float)[codes], minlength=n) if len(doc) else np.zeros(n)
    first = np.concatenate([[0], np.cumsum(words)])
    # windows of three words, found twice or more in a text: equal keys lie together, in the order of the texts
    covered = np.zeros(len(doc) + 1, np.int64)
    wide = len(values)
    if len(doc) > 2:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        pair = codes[at] * wide + codes[at + 1]
        if wide >= 1 << 21:  # the place of a pair among all, so that a third word still fits into 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair * wide + codes[at + 2]
        order = np.argsort(key, kind="stable")
        same = (key[order[1:]] == key[order[:-1]]) & (doc[at[order[1:]]] == doc[at[order[:-1]]])
        twice = np.zeros(len(doc), bool)
        for side in (order[1:][same], order[:-1][same]):
            for k in range(3):
                twice[at[side] + k] = True
        covered[1:] = np.cumsum(twice)
    repeats = covered[first[1:]] - covered[first[:-1]]
    distinct = np.bincount(np.unique(doc * wide + codes) // max(1, wide), minlength=n)
    word_chars, symbols, dup_lines, lines = (np.zeros(n, np.int64) for _ in range(4))
    for i, text in enumerate(texts.to_pylist()):
        raw = text.encode("utf-8", "surrogatepass")
        word_chars[i] = len(text) - (len(raw) - len(raw.translate(None, BLANK)))
        symbols[i] = len(raw) - len(raw.translate(None, SYMBOLS))
        held = [x for x in raw.split(b"\n") if x.strip()]
        lines[i], dup_lines[i] = len(held), len(held) - len(set(held))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda x: np.where(words > 0, x / words, np.nan)
        read = {
            "symbols": share(symbols), "repeats": share(repeats), "dup_lines": np.where(lines > 1, dup_lines / lines, np.nan),
            "capitals": share(total(pc.and_(pc.utf8_is_upper(values), pc.greater(pc.utf8_length(values), 1)))), "exclaims": share(total(pc.ends_with(values, "!"))),
            "word_length": share(word_chars), "lettered": share(total(pc.match_substring_regex(values, r"\pL"))),
            "distinct": np.where(words >= 50, distinct / words, np.nan), "common": np.where(words >= 50, share(total(pc.is_in(pc.utf8_trim(pc.utf8_lower(values), ".,;:!?"), value_set=pa.array(COMMON, pa.large_string())))), np.nan),
            "words": words.astype(float),
        }
    return dict(zip(COUNTS, (words, word_chars, symbols, dup_lines, repeats))), read


def votes(read: dict[str, np.ndarray]) -> np.ndarray:
    """1 good, -1 poor, 0 abstains; a column for each rule."""
    found = []
    for name, poor, good, side in RULES:
        x, vote = read[name], np.zeros(len(read[name]), np.int8)
        if good is not None:
            vote[x <= good if side == "high" else x >= good] = 1
        if poor is not None:
            vote[x >= poor if side == "high" else x <= poor] = -1
        found.append(vote)
    return np.stack(found, axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the votes of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                counts, read = measure(batch.column(1).slice(a, b - a))
                cast = votes(read)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(cast.tolist(), pa.list_(pa.int8()))], names=["doc_id", *COUNTS, "votes"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", votes array<tinyint>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def members(group: tuple[str, ...]) -> list[int]:
    """The places of a group's rules."""
    return [[r[0] for r in RULES].index(name) for name in group]


def grouped(patterns: np.ndarray) -> np.ndarray:
    """The number of each group's joint vote, base three (poor 0, abstains 1, good 2; the first rule counts least)."""
    return np.stack([sum((patterns[:, j].astype(int) + 1) * 3**k for k, j in enumerate(members(g))) for g in GROUPS], axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> tuple[list[np.ndarray], float]:
    """Expectation-maximisation: log odds of good for each joint vote of each group, and the base."""
    sizes = [3 ** len(g) for g in GROUPS]
    if not len(patterns):
        return [np.zeros(n) for n in sizes], 0.0
    cast, n = grouped(patterns), counts.sum()
    weight = PRIOR_WEIGHT * n
    prior = {}
    for kind, (poor, good) in PRIOR.items():
        prior[kind] = [np.array([poor, 1 - poor - good, good])]
        while len(prior[kind]) < max(map(len, GROUPS)):
            prior[kind].append(np.outer(prior[kind][0], prior[kind][-1]).ravel())
    said = [np.sign(sum(patterns[:, j].astype(int) for j in members(g))) for g in GROUPS]
    lean = np.sum([np.where(s < 0, 2 * s, s) for s in said], axis=0)  # at first groups have a vote each; poor ones are rarer and count double
    p = 1 / (1 + np.exp(-(1.0 + lean)))
    for _ in range(rounds):
        share = (counts @ p + 0.8 * weight) / (n + weight)
        tables = []
        for g, size in enumerate(sizes):
            log = [np.log((np.bincount(cast[:, g], weights=own, minlength=size) + weight * prior[kind][len(GROUPS[g]) - 1]) / (own.sum() + weight)) for kind, own in (("good", p * counts), ("poor", (1 - p) * counts))]
            tables.append(log[0] - log[1])
        model = tables, float(np.log(share / (1 - share)))
        new = posterior(patterns, model)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def train(stats: DataFrame) -> tuple[list[np.ndarray], float]:
    """Fits the rules on the vote patterns of all documents."""
    rows = stats.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^rules rows
    rows.sort(key=lambda r: r.votes)
    return fit(np.array([r.votes for r in rows], np.int8).reshape(len(rows), len(RULES)), np.array([r.n for r in rows], float))


def posterior(patterns: np.ndarray, model: tuple[list[np.ndarray], float]) -> np.ndarray:
    tables, base = model
    odds = base + sum(table[cast] for table, cast in zip(tables, grouped(patterns).T))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _odds(model: tuple[list[np.ndarray], float], votes: str) -> Column:
    """The posterior of a row from its column of votes."""
    tables, base = model
    odds = F.lit(base)
    for group, table in zip(GROUPS, tables):
        joint = sum(((F.element_at(votes, j + 1).cast("int") + 1) * 3**k for k, j in enumerate(members(group))), F.lit(1))
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in table)), joint.cast("int"))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, quality (the posterior) and kept of every document."""
    stats = materialise(measured(docs), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed).withColumn("quality", _odds(train(stats), "votes"))
    return rows.select("doc_id", *COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with all their columns, without those that fail the base rules or the verdict.

    Texts are read once: the votes are written beside the rows, and the verdict is an expression over them.
    """
    at, (cast_as, failed_as) = docs.columns.index("text"), (unused(x, docs.columns) for x in ("votes", "failed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(at), CHUNK):
                part = batch.slice(a, b - a)
                counts, read = measure(part.column(at))
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(votes(read).tolist(), pa.list_(pa.int8())), pa.array(failed)], names=[*part.schema.names, cast_as, failed_as])

    schema = T.StructType([*docs.schema.fields, T.StructField(cast_as, T.ArrayType(T.ByteType())), T.StructField(failed_as, T.BooleanType())])
    rows = materialise(docs.mapInArrow(run, schema), "voted")
    model = train(rows.select(F.col(cast_as).alias("votes")))
    return rows.where(~F.col(failed_as) & (_odds(model, cast_as) >= least)).drop(cast_as, failed_as)
