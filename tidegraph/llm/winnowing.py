"""Document fingerprints by winnowing (operator 2), in DataFrame functions alone.

The words of a text (lower case, cut at white space) are hashed; a Karp-Rabin polynomial over ``k``
words in a row gives the k-gram hashes, put together from those of shorter runs. Of every ``window``
k-grams in a row the least hash is kept, the rightmost on ties, with its position. Two texts that
share ``window + k - 1`` words in a row therefore share a kept hash, at the positions told.

A value is (hash << 32 | 2^32 - 1 - position), so the least value of a window is the least hash and,
on ties, the rightmost; sliding minima are taken over windows of doubling width. The polynomial has 31 bits,
enough to choose by; the hash that a fingerprint tells of a kept k-gram has 31 more, from a second hash of
its words, so that chance hits are rare among many documents.

Defined results: a null or empty text has no k-gram and an empty fingerprint; one with fewer words
than ``k`` has its whole word sequence as its only k-gram; a text of any length is one row, read whole; two
empty fingerprints are alike (1), an empty and another are not (0). Repeated rows stay, a row each; a null
``doc_id`` comes first; rows of one ``doc_id`` lie in one range, in the order of their texts; an empty table
gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Modulus (a prime) and base of the polynomial.
PRIME, BASE = 2**31 - 1, 1_103_515_245
#: Ranges of ids for each shuffle partition.
RANGES = 4


def _after(values: Column, n: int) -> Column:
    return F.slice(values, n + 1, F.size(values))


def _joined(left: Column, right: Column, words: int) -> Column:
    """Hashes of runs, from those of their beginnings and of the ``words`` words that follow; past the end counts as 0."""
    factor = pow(BASE, words, PRIME)
    return F.zip_with(left, right, lambda a, b: (a * F.lit(factor) + F.coalesce(b, F.lit(0))) % F.lit(PRIME))


def with_grams(rows: DataFrame, text: str, out: str, k: int) -> DataFrame:
    """Adds the values of all k-grams of ``text``, and (as ``<out>_words``) the hashes of its words."""
    words = F.array_remove(F.split(F.lower(text), "\\s+"), "")
    rows = rows.withColumn(out, F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(PRIME))))
    one = F.col(f"_{out}1")
    rows = rows.withColumnRenamed(out, f"_{out}1")
    have, width = f"_{out}1", 1
    for digit in bin(k)[3:]:  # left to right, as powers are taken
        rows = rows.withColumn(f"_{out}{2 * width}", _joined(F.col(have), _after(F.col(have), width), width))
        have, width = f"_{out}{2 * width}", 2 * width
        if digit == "1":
            rows = rows.withColumn(f"_{out}{width + 1}", _joined(F.col(have), _after(one, width), 1))
            have, width = f"_{out}{width + 1}", width + 1
    count = F.greatest(F.size(one) - (k - 1), F.least(F.size(one), F.lit(1)))
    values = F.transform(F.slice(F.col(have), 1, count), lambda h, i: F.shiftleft(h, 32).bitwiseOR(F.lit(2**32 - 1) - i))
    return rows.withColumn(out, values).withColumn(f"{out}_words", one).drop(*(c for c in rows.columns if c.startswith(f"_{out}")))


def with_kept(rows: DataFrame, values: str, out: str, window: int) -> DataFrame:
    """Adds the values that some window keeps, in the order of their positions."""
    low, width, name = F.col(values), 1, values
    while width < window:
        step = min(width, window - width)
        rows = rows.withColumn(f"_{out}{width + step}", F.zip_with(F.col(name), _after(F.col(name), step), lambda a, b: F.least(a, b)))
        name, width = f"_{out}{width + step}", width + step
    low = F.slice(F.col(name), 1, F.greatest(F.size(values) - (window - 1), F.least(F.size(values), F.lit(1))))
    return rows.withColumn(out, F.array_distinct(low)).drop(*(c for c in rows.columns if c.startswith(f"_{out}")))


def position(value: Column) -> Column:
    return F.lit(2**32 - 1) - value.bitwiseAND(F.lit(2**32 - 1))


def hashes(kept: str, words: str, k: int) -> Column:
    """The 62-bit hash of every kept k-gram, from its value and the hashes of its words."""
    second = lambda v: F.xxhash64(F.slice(F.col(words), (position(v) + 1).cast("int"), F.lit(k))).bitwiseAND(F.lit(PRIME))
    return F.transform(kept, lambda v: F.shiftleft(F.shiftright(v, 32), 31).bitwiseOR(second(v)))


def written(kept: str, found: str) -> Column:
    """``hash@position`` of every kept k-gram (hash in hex, position in words from 0)."""
    return F.concat_ws(" ", F.zip_with(kept, found, lambda v, h: F.concat(F.lower(F.hex(h)), F.lit("@"), position(v).cast("string"))))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two lists of hashes as sets."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_fingerprint(rows: DataFrame, text: str, kept: str, found: str, k: int, window: int) -> DataFrame:
    """Adds the kept values and the hashes of their k-grams."""
    rows = with_kept(with_grams(rows, text, "grams", k), "grams", kept, window)
    return rows.withColumn(found, hashes(kept, "grams_words", k)).drop("grams", "grams_words")


def fingerprint(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """doc_id, fingerprint and its ``hashes`` of every whole text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "kept", "hashes", k, window)
    return rows.select("doc_id", written("kept", "hashes").alias("fingerprint"), "hashes")


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a range of ids for each row, with the rows that come next at the ends of the ranges.

    Ranges start at ids of rows (quantiles, found on the id column alone). The first rows of a range
    also go to the range before, and the very first to the last one, as guests: so the next row of
    each is found within a range, and no task needs the whole table in order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("at"), F.min("doc_id").alias("low"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    cuts, low = sorted({x for x in cuts["at"] or [] if x > cuts["low"] or cuts["nulls"]}), None if cuts["nulls"] else cuts["low"]
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if groups:  # two short searches in place of a long one
        below = lambda array: F.size(F.filter(array, lambda c: c <= F.col("doc_id")))
        listed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # one constant of the plan, however many there are
        nested = listed(groups, "array<array<bigint>>")
        coarse = below(listed([g[0] for g in groups], "array<bigint>"))
        rows = rows.withColumn("coarse", F.when(F.col("doc_id").isNull(), 0).otherwise(coarse))
        fine = F.when(F.col("coarse") == 0, 0).otherwise((F.col("coarse") - 1) * step + below(F.element_at(nested, F.greatest(F.col("coarse"), F.lit(1)))))
        starts = F.array_contains(F.element_at(nested, F.greatest(F.col("coarse"), F.lit(1))), F.col("doc_id"))
        rows = rows.withColumn("range", fine).withColumn("starts", F.coalesce(starts, F.lit(False)) & (F.col("range") > 0)).drop("coarse")
    else:
        rows = rows.withColumn("range", F.lit(0)).withColumn("starts", F.lit(False))
    places = [F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))]
    places.append(F.when(F.col("starts"), F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))))
    places.append(F.when(F.col("doc_id").eqNullSafe(F.lit(low)), F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("guest"))))
    return rows.select(F.inline(F.array_compact(F.array(*places))), "doc_id", "text").repartition("range")


def compare_edited(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    The edited text has its last quarter of code points replaced by the first as many of the next
    document's, in ascending doc_id (equal ids by text); the first follows the last.
    """
    rows = with_fingerprint(beside_next(docs), "text", "kept", "own", k, window)
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns({"after": F.lead("text").over(order), "next": F.lead("own").over(order)}).where("guest = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.substring("after", F.lit(1), F.col("cut")))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "ekept", "theirs", k, window)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("kept", "own").alias("fingerprint"), written("ekept", "theirs").alias("edited_fingerprint"),
        likeness("own", "theirs").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
