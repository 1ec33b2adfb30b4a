"""Mixing to target weights with soft membership (operator 1).

The domains are the classes of the label table (quality and toxic, 0 or 1 each). A classifier fitted
on labelled documents predicts the posterior p of every domain for every document. Nonnegative rates r
(how often a document is taken) then bring the expected tokens of the domains, the sum of r * tokens * p,
to their targets in the least-squares sense, by projected gradient from rates of 1.

With S the expected tokens and T the targets, the gradient of a document's rate is its tokens times
p . M (S - T), M being the matrix that the squares are taken in. In each step every rate moves against
its gradient (for each token) and is projected to 0 or more: r <- max(0, r - p . M (S - T)). So a step is
told by one number for each domain, a task replays all steps for each of its documents, and one pass adds
up S. M is the inverse Gram matrix (with a small ridge) of the documents whose rate is over 0, with which few steps suffice; when
such a step takes less than ``GAIN`` of the squared miss away, steps go on with the Gram matrix of all
documents, with which plain steps always converge, and with momentum. Steps end when every domain is
within ``WITHIN`` of its target, or when ``PATIENCE`` steps got no closer: then the targets contradict
each other on these documents, ``Rates.met`` is false, and a warning says so.

Most steps are found on a table of at most some 6,000 rows: the tokens of the documents by their posteriors,
each rounded to a multiple of 1 / ``LEVELS``, with the mean of the posteriors in each cell. The steps then
go on over all documents, whose sums alone tell whether the targets are met.

Targets are relative to an anchor domain, whose tokens grow to ``anchor_rate`` times what they are. No
domain grows to more than ``most`` times what it has: the target of one that hardly any document belongs
to is lowered to that (``Rates.want`` tells the targets that steps go to), else others would pay for it. Whether
the targets are met is judged by what was asked, so a lowered target is never met, and a warning says so.

The classifier is fitted on at most ``sample`` labelled documents (rows, those of least hash): naive
Bayes log ratios over the hashed words that stand out in a domain, then a multinomial logistic regression
of the labels on their sums over held-out documents. All else covers all documents.

Defined results: a null or empty text has no tokens, the prior's posteriors and a rate as any other; a
text of any length is read whole (one over ``CHUNK`` bytes alone); labels with a null are not used, and a
document with several labels counts with each; without usable labels every posterior is 1/4; repeated
rows are mixed each, and rows with equal id and rate have the same number of copies; a null ``doc_id``
counts as 0 where copies are drawn; an empty table gives an empty result; extra columns, whatever their
names, are ignored by ``mix`` and passed on by ``take``.
"""

from __future__ import annotations

import json
import re
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .storage import materialise, unused
from .tokenize import chunks

#: Domains, as 2 * quality + toxic, and their share of the tokens that the mix asks for.
DOMAINS = ["poor", "poor_toxic", "good", "good_toxic"]
TARGETS = {"poor": 0.05, "poor_toxic": 0.005, "good": 0.925, "good_toxic": 0.02}
ANCHOR = "good"
BUCKETS = 1 << 14
#: Bytes of text handled at once: a worker holds some 30 times as much.
CHUNK = 3 << 20
#: The same where the rows go through whole, beside their posteriors.
BESIDE = 2 << 20
#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: How much a domain may grow.
MOST = 4.0
#: How near each domain's tokens come to their target: as a part of it, or (if that is more) of all tokens.
WITHIN, OF_ALL = 5e-3, 2.5e-5
#: Added to the diagonal of Gram matrices (of all tokens): a domain that hardly any document belongs to weighs little in the squares.
RIDGE_GRAM = 1e-3
#: Steps at most; the least part of the squared miss that a step of the first kind takes away; steps of the second kind that must take a hundredth.
STEPS, GAIN, PATIENCE = 150, 0.2, 10
#: A squared miss (of all tokens) under this is none, or of a kind that no rates can change.
NOUGHT = 1e-14
#: Cells along each domain of the table that the first steps are found on, and steps over all documents after these.
LEVELS, OVER_ALL = 32, 6
#: Standard deviations by which a feature must stand out in a domain to count, and documents that must show it.
SURE, SEEN = 4.0, 5
FIT_STEPS, RIDGE = 600, 1e-4
EDGES = re.compile(r"^\W+|\W+$")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features of every text: owner and bucket, sorted by owner; and the texts' words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    has = pc.greater(pc.binary_length(flat), 0)
    coded, owner = flat.filter(has).dictionary_encode(), owner.filter(has).to_numpy().astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values = coded.dictionary.to_pylist()
    base, shape = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for i, w in enumerate(values):
        core = w if w[0].isalnum() and w[-1].isalnum() else EDGES.sub("", w)
        base[i] = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - 512)
        shape[i] = BUCKETS - 512 + (ord(w[-1]) % 128 if not w[-1].isalnum() else 128 if len(w) > 1 and w.isupper() else 129)
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    distinct = np.bincount(np.unique(owner << 32 | codes) >> 32, minlength=n)
    told = np.flatnonzero(words >= 20)
    fresh = BUCKETS - 512 + 130 + 10 * distinct[told] // words[told]
    pair = np.unique(np.concatenate([owner * BUCKETS + base[codes], owner * BUCKETS + shape[codes], told * BUCKETS + fresh]))
    return pair // BUCKETS, pair % BUCKETS, words


class Classifier:
    """Posteriors of the domains: naive Bayes sums, calibrated by a logistic regression."""

    def __init__(self):
        self.ratios, self.weights = np.zeros((BUCKETS, len(DOMAINS))), np.zeros((len(DOMAINS) + 2, len(DOMAINS)))

    def scores(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        sums = np.stack([np.bincount(owner, weights=self.ratios[bucket, c], minlength=n) for c in range(len(DOMAINS))], axis=1)
        size = np.bincount(owner, minlength=n)[:, None]
        return np.concatenate([np.clip(sums, -30, 30), np.log1p(size) / 5, np.ones((n, 1))], axis=1)

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        z = scores @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, documents: list[np.ndarray], classes: np.ndarray) -> "Classifier":
        """Two thirds of the documents count words, the others fit the regression."""
        if not len(classes):
            return self
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        bucket = np.concatenate([*documents, np.empty(0, np.int64)]).astype(np.int64)
        counting = np.arange(len(classes)) % 3 > 0
        here = counting[owner]
        shown = np.stack([np.bincount(bucket[here & (classes[owner] == c)], minlength=BUCKETS) for c in range(len(DOMAINS))], axis=1)
        of = np.bincount(classes[counting], minlength=len(DOMAINS))
        overall = (shown.sum(1, keepdims=True) + 0.5) / (of.sum() + 1)
        rate = (shown + 4 * overall) / (of + 4)  # few documents of a domain: drawn towards all
        every, n, rest = shown.sum(1, keepdims=True), of.sum(), np.maximum(1, of.sum() - of)
        apart = np.abs(shown / np.maximum(1, of) - (every - shown) / rest)  # of the shares that show a feature
        spread = every / n * (1 - every / n) * (1 / np.maximum(1, of) + 1 / rest)
        sure = (apart > SURE * np.sqrt(spread)) & (every >= SEEN) & (of > 0) & (of < n)
        self.ratios = np.where(sure, np.log(rate / overall), 0.0)
        x = self.scores(owner, bucket, len(documents))[~counting]
        if not len(x):
            x, y = self.scores(owner, bucket, len(documents)), classes
        else:
            y = classes[~counting]
        target = np.eye(len(DOMAINS))[y]
        middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        middle[-1], scale[-1] = 0, 1  # the constant
        x = (x - middle) / scale
        step = 1 / (0.5 * np.linalg.norm(x.T @ x / len(x), 2) + RIDGE)
        w = ahead = np.zeros((x.shape[1], len(DOMAINS)))
        for k in range(FIT_STEPS):  # accelerated gradient, with the step that the curvature allows
            z = x @ ahead
            e = np.exp(z - z.max(axis=1, keepdims=True))
            new = ahead - step * (x.T @ (e / e.sum(axis=1, keepdims=True) - target) / len(x) + RIDGE * ahead)
            w, ahead = new, new + k / (k + 3) * (new - w)
        self.weights = w / scale[:, None]
        self.weights[-1] -= middle @ self.weights
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits the classifier on the documents of at most ``sample`` labelled ids."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (2 * F.col("quality").cast("int") + F.col("toxic").cast("int")).alias("domain")).where("doc_id is not null and domain between 0 and 3")
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                owner, bucket, _ = features(batch.column(1).slice(a, b - a))
                at = np.searchsorted(owner, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))], names=["doc_id", "domain", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    found = rows.select("doc_id", "text", "domain").mapInArrow(run, "doc_id long, domain int, buckets array<int>")
    # an id may have any number of rows: of these, too, at most `sample` in all, each of at most BUCKETS numbers
    found = found.orderBy(F.xxhash64("doc_id", "buckets"), "doc_id", "domain").limit(sample).toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("domain", "ascending")])
    lists = found.column("buckets").combine_chunks()
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    return Classifier().fit([flat[x:y] for x, y in zip(at[:-1], at[1:])], found.column("domain").to_numpy().astype(np.int64))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and the posterior of every domain, for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                owner, bucket, words = features(batch.column(1).slice(a, b - a))
                p = model.posteriors(model.scores(owner, bucket, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.int64()), *map(pa.array, np.ascontiguousarray(p.T))], names=["doc_id", "n_tokens", *DOMAINS])

    schema = "doc_id long, n_tokens long, " + ", ".join(f"{d} double" for d in DOMAINS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rates:
    """The steps that lead to the rates (a number for each domain, and the momentum), the domains' expected tokens, their targets (lowered to ``most``), what was asked, and whether that is met."""

    steps: np.ndarray
    have: np.ndarray
    want: np.ndarray
    met: bool
    asked: np.ndarray

    def of(self, p: np.ndarray) -> np.ndarray:
        """The rate of every row of posteriors."""
        return replayed(p, self.steps)[0]


def replayed(p: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of rows of posteriors after projected steps from 1, and the point that momentum carries them to."""
    r = ahead = np.ones(len(p))
    for *step, momentum in steps:
        new = np.maximum(0, ahead - p @ np.array(step))
        ahead = new + momentum * (new - r) if momentum else new
        r = new
    return r, ahead


def summed(p: np.ndarray, t: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For some documents: tokens of the domains under the rates and under those ahead, Gram matrices of the documents with a rate and of all."""
    r, ahead = replayed(p, steps)
    gram = lambda weight: (p.T @ (p * weight[:, None])).reshape(-1)
    return np.concatenate([p.T @ (t * r), p.T @ (t * ahead), gram(t * (r > 0)), gram(t)])


def cells(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean posteriors and tokens of the documents in each cell of rounded posteriors (at most (LEVELS + 5)^3 / 6 or so, whatever the corpus)."""
    names = [f"c{i}" for i in range(len(DOMAINS))]
    rows = members.select("n_tokens", *DOMAINS, *(F.round(F.col(d) * LEVELS).cast("int").alias(c) for d, c in zip(DOMAINS, names)))
    found = rows.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("t"), *(F.sum(F.col("n_tokens") * F.col(d)).alias(d) for d in DOMAINS)).where("t > 0").orderBy(*names).collect()
    t = np.array([r.t for r in found])
    return np.array([[r[d] for d in DOMAINS] for r in found]).reshape(-1, len(DOMAINS)) / t[:, None], t


def solve(members: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, anchor_rate: float = 1.05, most: float = MOST) -> Rates:
    """Nonnegative rates whose expected tokens are as near to the targets as can be. ``members``: n_tokens and posteriors."""
    n = len(DOMAINS)

    def sums(steps: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * n + 2 * n * n)
            for batch in batches:
                t, *p = (np.asarray(c, float) for c in batch.columns)
                total += summed(np.stack(p, axis=1), t, steps)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        parts = members.select("n_tokens", *DOMAINS).mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
        found = {r.i: r.s for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}  # a row for each number
        return np.array([found.get(i, 0.0) for i in range(2 * n + 2 * n * n)])

    p, t = cells(members)
    first = projected_gradient(lambda steps: summed(p, t, steps), targets, anchor, anchor_rate, most)
    found = projected_gradient(sums, targets, anchor, anchor_rate, most, first.steps, OVER_ALL)
    if not found.met:
        told = lambda x: {d: round(float(v)) for d, v in zip(DOMAINS, x)}
        warnings.warn(f"the targets cannot all be met: {told(found.asked)} tokens wanted, {told(found.want)} with the limit to growth, {told(found.have)} reached", stacklevel=3)
    return found


def projected_gradient(sums: Callable[[np.ndarray], np.ndarray], targets: dict[str, float], anchor: str, anchor_rate: float, most: float = MOST, steps: np.ndarray | None = None, room_for: int | None = None) -> Rates:
    """The steps to the targets, after ``steps`` and at most ``room_for`` more. ``sums``: what ``summed`` gives over all documents."""
    n = len(DOMAINS)

    def passed(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = sums(steps)
        return s[:n], s[n : 2 * n], s[2 * n : 2 * n + n * n].reshape(n, n), s[2 * n + n * n :].reshape(n, n)

    none = np.zeros((0, n + 1))
    at_one, _, active, every = passed(none)
    total = at_one.sum()
    if not total:
        return Rates(none, at_one, at_one, True, at_one)
    asked = np.array([targets[d] for d in DOMAINS]) / targets[anchor] * at_one[DOMAINS.index(anchor)] * anchor_rate
    want = np.minimum(asked, most * at_one)
    room = np.maximum(WITHIN * want, OF_ALL * total)
    inverse = lambda gram: np.linalg.inv(gram / total + RIDGE_GRAM * np.eye(n))
    whole = inverse(every)
    size = lambda x: float((x - want) @ whole @ (x - want)) / total**2
    met = lambda x: bool((np.abs(x - want) <= room).all())
    have, steps = at_one, none if steps is None else steps
    if len(steps):
        have, _, active, _ = passed(steps)
    last, before = len(steps) + (STEPS if room_for is None else room_for), np.inf
    while not met(have) and NOUGHT < size(have) < (1 - GAIN) * before and len(steps) < last:  # first kind
        before, best = size(have), (steps, have)
        steps = np.vstack([steps, [*(inverse(active) @ (have - want) / total), 0.0]])
        have, _, active, _ = passed(steps)
    if size(have) >= before:
        steps, have = best
    ahead, best, mark, since, k = have, (steps, have), size(have), 0, 0
    while not met(best[1]) and size(best[1]) > NOUGHT and since < PATIENCE and len(steps) < last:  # second kind
        steps = np.vstack([steps, [*(whole @ (ahead - want) / total), k / (k + 3)]])
        have, ahead, _, _ = passed(steps)
        k, since = k + 1, since + 1
        if met(have) or size(have) < size(best[1]):
            best = (steps, have)
        if size(best[1]) < 0.99 * mark:
            mark, since = size(best[1]), 0
    steps, have = best
    full = bool((np.abs(have - asked) <= np.maximum(WITHIN * asked, OF_ALL * total)).all())
    return Rates(steps, have, want, full, asked)


def rate_of(steps: np.ndarray, names: list[str]) -> Column:
    """``Rates.of`` as an expression over columns of posteriors, for rows whose texts need not go to Python again."""
    listed = F.from_json(F.lit(json.dumps([list(map(float, s)) for s in steps])), "array<array<double>>")  # one constant of the plan

    def step(held: Column, s: Column) -> Column:
        pushed = sum((F.col(f"`{d}`") * s[i] for i, d in enumerate(names[1:], 1)), F.col(f"`{names[0]}`") * s[0])
        new = F.greatest(F.lit(0.0), held["ahead"] - pushed)
        return F.struct(new.alias("r"), (new + s[len(names)] * (new - held["r"])).alias("ahead"))

    return F.aggregate(listed, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("ahead")), step, lambda held: held["r"])


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole numbers of copies whose mean is the rate, drawn by the hash of the id."""
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")), F.lit("copies")), 11) / F.lit(float(2**53))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, anchor_rate: float = 1.05, most: float = MOST) -> DataFrame:
    """doc_id, n_tokens, the posteriors, rate, copies, and whether the targets are met, of every document."""
    members = materialise(posteriors(docs, train(docs, labels, sample)), "posteriors")
    found = solve(members, targets, anchor_rate=anchor_rate, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([np.asarray(c, float) for c in batch.columns[2:]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.of(p))], names=[*batch.schema.names, "rate"])

    rows = members.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", rate double")
    return rows.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"))).withColumn("targets_met", F.lit(found.met))


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, anchor_rate: float = 1.05, most: float = MOST) -> DataFrame:
    """The documents with all their columns, each as often as its copies say.

    Texts are read once: the posteriors are written beside the rows, and the passes of ``solve`` read these alone.
    """
    model = train(docs, labels, sample)
    at = docs.columns.index("text")
    extra = [unused(x, docs.columns) for x in ("n_tokens", *DOMAINS)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(at), BESIDE):
                part = batch.slice(a, b - a)
                owner, bucket, words = features(part.column(at))
                p = model.posteriors(model.scores(owner, bucket, b - a))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words, pa.int64()), *map(pa.array, np.ascontiguousarray(p.T))], names=[*part.schema.names, *extra])

    schema = T.StructType([*docs.schema.fields, T.StructField(extra[0], T.LongType()), *(T.StructField(x, T.DoubleType()) for x in extra[1:])])
    scored = materialise(docs.mapInArrow(score, schema), "scored")
    found = solve(scored.select(*(F.col(x).alias(y) for x, y in zip(extra, ("n_tokens", *DOMAINS)))), targets, anchor_rate=anchor_rate, most=most)
    many, rate = unused("copies", scored.columns), unused("rate", scored.columns)
    rows = scored.withColumn(rate, rate_of(found.steps, extra[1:])).withColumn(many, copies_of(F.col(rate), F.col("doc_id")))
    rows = rows.where(F.col(many) > 0).withColumn(many, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many))))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
