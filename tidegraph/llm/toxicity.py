"""Toxicity of texts that are written to hide it, by a noisy channel (operator 12).

What was meant is restored before a text is scored: leetspeak, letters spelled apart and repeated letters are
a lattice of what the writer may have meant, and the likeliest way through it (Viterbi) under a character
language model is taken. The model is the trigrams of characters of all documents, counted over the whole corpus.
Only places that look altered are decoded (a digit or sign beside letters, a letter three times in a row, three
single characters in a row); all else stays.

The restored text is scored by logistic regression over the character n-grams (3 to 5, within words and with their
ends) that tell toxic from other texts best. It is fitted on at most ``fit_rows`` labelled rows, chosen by a hash
of their ids, none of which is held out; ``doc_id``, language and source are no inputs.

Defined results: a null or empty text has no n-gram and gets what the model says of that; a text of any length is
read whole; repeated rows are scored each and equal texts alike; of several labels of a document the highest counts;
a score right at the limit is predicted 1; a null ``doc_id`` is kept, held out and takes no label; without labels,
or with labels of one kind alone, every score is the share of toxic ones (0 without any); an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import drop, materialise
from .tokenize import chunks

#: Labelled rows that the classifier is fitted on at most, and n-grams that it reads.
FIT_ROWS, FEATURES = 20_000, 1024
#: Bytes of text handled at once, and decoded places that a task remembers.
CHUNK, REMEMBERED = 1 << 20, 200_000
SIZES = (3, 4, 5)

#: What digits and signs stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
#: Log probabilities of the channel: a letter written as a sign, a sign that is meant as one, a letter repeated or doubled,
#: a word broken by a sign, and the end of a word among letters that are spelled apart.
AS_SIGN, MEANT, REPEATED, DOUBLED, BROKEN, ENDED = -1.0, -8.0, -1.0, -2.5, -3.0, -5.0

#: Symbols of the language model: 0 parts words, then a-z, the small letters of Latin-1, and all other letters as one.
BITS, OTHER = 6, 59
_latin = [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]
SYMBOL = np.array([OTHER if chr(i).isalpha() else 0 for i in range(0x3000)], np.uint8)
SYMBOL[_latin] = np.arange(1, len(_latin) + 1)
LETTER, SIGN, BLANK = 1, 2, 3
KIND = np.array([LETTER if chr(i).isalpha() else SIGN if chr(i) in LEET else BLANK if chr(i).isspace() else 0 for i in range(0x3000)], np.uint8)


def code_points(texts: list[str]) -> np.ndarray:
    """The texts in lower case, a line feed after each."""
    joined = "\n".join([*(t.lower() for t in texts), ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def _looked_up(table: np.ndarray, points: np.ndarray, beyond: int) -> np.ndarray:
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], np.uint8(beyond))


def symbols(points: np.ndarray) -> np.ndarray:
    return _looked_up(SYMBOL, points, OTHER)


# The language model


def trigrams(texts: list[str]) -> np.ndarray:
    """How often each symbol follows each pair of symbols within words, their ends included."""
    x = symbols(code_points(texts)).astype(np.int32)
    a, b = (np.concatenate([np.zeros(k, np.int32), x])[: len(x)] for k in (2, 1))
    a[b == 0] = 0
    return np.bincount(((a << BITS | b) << BITS | x)[(b > 0) | (x > 0)], minlength=1 << 3 * BITS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after two, smoothed by those after one and after none."""
    n = counts.reshape(1 << BITS, 1 << BITS, 1 << BITS).astype(float)
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * (1 << BITS))
    two = (n.sum(0) + 8 * one) / (n.sum((0, 2))[:, None] + 8)
    return np.log((n + 8 * two) / (n.sum(2)[:, :, None] + 8)).ravel()


def corpus_model(docs: DataFrame) -> np.ndarray:
    """The language model of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 3 * BITS, np.int64)
        for batch in batches:
            for a, b in chunks(batch.column(0), CHUNK):
                total += trigrams([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["gram", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << 3 * BITS, np.int64)
    for gram, n in found.collect():  # at most 2^18 rows
        counts[gram] = n
    return language_model(counts)


# The channel


def lattice(place: str) -> list[list[tuple[str, float]]]:
    """For each run of a character, what may be meant by it and the log probability of writing it so."""
    steps, i = [], 0
    written = lambda k: 0 <= k < len(place) and (place[k].isalpha() or place[k] in LEET)
    while i < len(place):
        c, j = place[i], i
        while j < len(place) and place[j] == c:
            j += 1
        n, meant = j - i, LEET.get(c)
        if meant:
            steps.append([(x, AS_SIGN + (REPEATED if n > 1 else 0)) for x in meant] + [(2 * x, AS_SIGN + (REPEATED if n > 2 else 0)) for x in meant if n > 1] + [(" ", MEANT)])
        elif c.isalpha():
            steps.append([(c, 0.0)] if n == 1 else [(2 * c, 0.0), (c, DOUBLED)] if n == 2 else [(c, REPEATED), (2 * c, REPEATED)])
        else:
            apart = n == 1 and not written(i - 2) and not written(j + 1)  # between single characters
            steps.append([(" ", ENDED), ("", 0.0)] if apart else [(" ", 0.0), ("", BROKEN)])
        i = j
    return steps


def restore(place: str, model: list[float]) -> str:
    """What was most likely meant: the best way through the lattice. ``model``: log probabilities of three symbols."""
    symbol = lambda c: 0 if c == " " else int(SYMBOL[ord(c)]) if ord(c) < len(SYMBOL) else OTHER
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # the last two symbols: score and what was put out
    for step in [*lattice(place), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple]] = {}
        for out, cost in step:
            coded = [symbol(c) for c in out]
            for state, (score, way) in states.items():
                score += cost
                for c in coded:
                    if c or state & 63:
                        score += model[state << BITS | c]
                    state = (state << BITS | c) & 4095 if c else 0
                if state not in after or after[state][0] < score:
                    after[state] = (score, (way, out))
        states = after
    way, out = max(states.values(), key=lambda x: x[0])[1], []
    while way:
        way, piece = way
        out.append(piece)
    return " ".join("".join(reversed(out)).split())


def altered(points: np.ndarray) -> np.ndarray:
    """Starts and ends of the places that look altered: between blanks, but blanks between single characters part nothing."""
    kind = np.concatenate([[BLANK] * 2, _looked_up(KIND, points, LETTER), [BLANK] * 4])
    letter, sign = kind == LETTER, kind == SIGN
    at = lambda x, k: x[2 + k : len(x) - 4 + k]  # noqa: E731  what stands ``k`` further on
    near = lambda k: at(letter, k) | at(sign, k)
    beside = at(letter, -1) & (at(letter, 1) | at(sign, 1) & at(letter, 2) | ~near(1) & (points != ord("!"))) | at(letter, 1) & ~near(-1)
    flag = at(sign, 0) & beside
    same = np.concatenate([[False], points[1:] == points[:-1], [False]])
    flag |= at(letter, 0) & same[1:] & same[:-1]
    single = near(0) & ~near(-1) & ~near(1)
    ahead = lambda k: np.concatenate([single[k:], np.zeros(min(k, len(single)), bool)])
    flag |= single & ahead(2) & ahead(4) & (at(letter, 0) & (at(letter, 2)))
    if not flag.any():
        return np.zeros((0, 2), np.int64)
    beyond = np.concatenate([single[1:], [False]]) & np.concatenate([[False], single[:-1]])
    parts = np.flatnonzero((at(kind, 0) == BLANK) & (~beyond | (points == 10)))
    unit = np.unique(np.searchsorted(parts, np.flatnonzero(flag)))
    starts, ends = np.concatenate([[0], parts + 1]), np.concatenate([parts, [len(points)]])
    return np.stack([starts[unit], ends[unit]], axis=1)


def restored(texts: list[str], model: list[float], known: dict[str, str]) -> list[str]:
    """The texts in lower case with what was meant in place of what looks altered."""
    points = code_points(texts)
    spans = altered(points)
    if not len(spans):
        return [t.lower() for t in texts]
    whole, out, at = points.tobytes().decode("utf-32-le", "surrogatepass"), [], 0
    for a, b in spans.tolist():
        place = whole[a:b]
        if (meant := known.get(place)) is None:
            meant = restore(place, model)
            if len(known) < REMEMBERED and len(place) < 100:
                known[place] = meant
        out += [whole[at:a], meant]
        at = b
    out.append(whole[at:])
    pieces, at = "".join(out).split("\n"), 0
    if len(pieces) == len(texts) + 1:
        return pieces[:-1]
    rows = []
    for text in texts:  # texts of several lines
        n = text.lower().count("\n") + 1
        rows.append("\n".join(pieces[at : at + n]))
        at += n
    return rows


# The classifier


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the code of every n-gram: no end of a word within, at most at its first and last place."""
    points = code_points(texts)
    x = symbols(points).astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts])  # the texts are in lower case already
    doc = np.repeat(np.arange(len(texts)), lengths)
    x, doc = np.concatenate([[0], x]), np.concatenate([[0], doc])
    found = []
    for k in SIZES:
        if len(x) < k:
            continue
        inner = np.lib.stride_tricks.sliding_window_view(x, k)[:, 1:-1].all(axis=1)
        at = np.flatnonzero(inner)
        code = np.full(len(at), k, np.int64)
        for j in range(k):
            code = code << BITS | x[at + j]
        found.append((doc[at + 1], code))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Chosen:
    """Finds which of some codes occur in texts: a table that no two of them share a place in."""

    def __init__(self, codes: np.ndarray, bits: int = 22):
        self.codes, self.bits, self.factor = codes, bits, 0x9E3779B97F4A7C15
        while True:
            place = self.place(codes)
            if len(np.unique(place)) == len(codes):
                break
            self.factor = self.factor * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1
        self.table = np.zeros(1 << bits, np.int16)
        self.table[place] = np.arange(1, len(codes) + 1)

    def place(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(self.factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def within(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text and a chosen code in it, each once."""
        doc, code = grams(texts)
        at = self.table[self.place(code)].astype(np.int64)
        hit = np.flatnonzero(at)
        hit = hit[self.codes[at[hit] - 1] == code[hit]]
        pairs = np.unique(doc[hit] * max(1, len(self.codes)) + at[hit] - 1)
        return pairs // max(1, len(self.codes)), pairs % max(1, len(self.codes))


def logistic(rows: np.ndarray, columns: np.ndarray, n_columns: int, y: np.ndarray, ridge: float = 0.5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and base of a logistic regression over flags (rows, columns), by accelerated gradient steps."""
    n = len(y)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w, base = np.zeros(n_columns), float(np.log(share / (1 - share)))
    held, held_base, seen = w, base, 1.0
    v = np.ones(n_columns)
    for _ in range(20):  # the steepest direction, for the length of a step
        v = np.bincount(columns, weights=np.bincount(rows, weights=v[columns], minlength=n)[rows], minlength=n_columns)
        steepest = np.linalg.norm(v)
        v = v / max(steepest, 1e-12)
    rate = 1 / (0.3 * (steepest + n) + ridge)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(held_base + np.bincount(rows, weights=held[columns], minlength=n), -50, 50)))
        miss = p - y
        new = held - rate * (np.bincount(columns, weights=miss[rows], minlength=n_columns) + ridge * held)
        new_base = held_base - rate * miss.sum()
        seen, before = (1 + (1 + 4 * seen * seen) ** 0.5) / 2, seen
        push = (before - 1) / seen
        if float((held - new) @ (new - w)) > 0:  # the steps have gone too far: start anew from here
            seen, push = 1.0, 0.0
        held, held_base = new + push * (new - w), new_base + push * (new_base - base)
        w, base = new, new_base
    return w, base


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text and toxic of the rows to fit on: at most ``fit_rows`` ids that are not held out, chosen by a hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, shared, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """The chosen codes, their weights and the base. ``shared``: the language model, handed out."""

    def restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value.tolist(), {}
        for batch in batches:
            for a, b in chunks(batch.column(0), CHUNK):
                texts = restored([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()], model, known)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1).slice(a, b - a)], names=["text", "toxic"])

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(0), CHUNK):
                toxic = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
                doc, code = grams(batch.column(0).slice(a, b - a).to_pylist())
                order = np.lexsort((doc, code))
                doc, code = doc[order], code[order]
                first = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])[: len(code)]
                own, at = np.unique(code[first], return_inverse=True)
                flag = toxic[doc[first]] > 0
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array(np.bincount(at, weights=x, minlength=len(own)).astype(np.int64), pa.int64()) for x in (flag, ~flag))], names=["code", "toxic", "clean"])

    texts = materialise(labelled(docs, labels, fit_rows).mapInArrow(restoring, "text string, toxic int"), "labelled")
    n, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    nothing = np.zeros(0, np.int64), np.zeros(0)
    if n_toxic in (0, n):
        return *nothing, 50.0 if n_toxic else -np.inf
    seen = texts.mapInArrow(counting, "code long, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, p, q = F.col("a").cast("double"), F.col("b").cast("double"), float(n_toxic), float(n - n_toxic)
    tells = (a * (q - b) - b * (p - a)) ** 2 / ((a + b) * (p + q - a - b) * p * q)
    best = seen.where((F.col("a") + F.col("b") >= 3) & (F.col("a") + F.col("b") < n)).orderBy(tells.desc(), "code").limit(features)
    codes = np.array(sorted(r.code for r in best.select("code").collect()), np.int64)
    chosen = Chosen(codes)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(0), CHUNK):
                doc, at = chosen.within(batch.column(0).slice(a, b - a).to_pylist())
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array([at[i:j].astype(np.int16).tobytes() for i, j in zip(ends, ends[1:])], pa.binary()), batch.column(1).slice(a, b - a)], names=["at", "toxic"])

    rows = texts.mapInArrow(flags, "at binary, toxic int").orderBy("toxic", "at").collect()  # at most ``fit_rows``, of two bytes for each n-gram at most
    drop(texts)
    columns = [np.frombuffer(r["at"], np.int16) for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    weights, base = logistic(at, np.concatenate(columns).astype(np.int64), len(codes), np.array([r.toxic > 0 for r in rows], float))
    return codes, weights, base


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (how likely toxic), predicted and the number of restored places of every document."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(corpus_model(docs))
    codes, weights, base = fit(docs, labels, shared, fit_rows, features)
    tool = context.broadcast((Chosen(codes), weights, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value.tolist(), {}
        chosen, own, low = tool.value
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                texts = restored([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], model, known)
                odds = np.full(b - a, low)
                if len(own):
                    doc, at = chosen.within(texts)
                    odds += np.bincount(doc, weights=own[at], minlength=b - a)
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-odds)), pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
