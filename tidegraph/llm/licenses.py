"""License scans by diagonal voting (operator 4).

Every run of words of a text (two and three words, hashed) is joined to the places of the license
templates that hold the same run; a hit is kept only if its words are the template's. A hit votes for
the diagonal (place in the text less place in the template); diagonals of a template that lie within
``SLACK`` words of each other are merged, which lets words be put in or left out, and a span stands if
it holds ``COVERED`` of the template's runs within about the template's length, one of them in no
template of another label.

Templates of two or three words are phrases: each of their hits is a place where the phrase stands.

Defined results: a null or empty text has no word, label or place and score 0; a text of any length is
read whole; repeated rows stay, a row each; ties (a share right at the limit) stand; a null ``doc_id`` is
kept; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .storage import materialise

#: Characters that part words, after lower-casing.
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K, SLACK, COVERED = 3, 4, 0.6
#: Templates up to which their runs (some 100 bytes each, a few dozen a template) are broadcast; more are joined by a shuffle.
BROADCAST_TEMPLATES = 20_000

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Notices and well-known passages of public licenses.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0-1.0"),
]


def words_of(text: Column) -> Column:
    """Words of a text. Lower-casing beyond A-Z parts no word and makes no ASCII letter but k, from the Kelvin sign."""
    return F.array_remove(F.split(F.lower(text), APART), "")


def runs(words: Column) -> tuple[Column, Column]:
    """Hashes of the two and of the three words from each place on."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    two = F.zip_with(one, F.slice(one, 2, F.size(one)), lambda a, b: F.xxhash64(a, b))
    return two, F.zip_with(two, F.slice(one, 3, F.size(one)), lambda a, b: F.xxhash64(a, b))


def template_runs(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """hash, template, at, run, label, phrase, n_runs: a few hundred rows, fixed by the lists. Template -1 stands for every text."""
    rows = [(i, t, label, i < len(phrases)) for i, (t, label) in enumerate([*phrases, *templates])]
    if any(len(t.split()) > K for t, _ in phrases):
        raise ValueError(f"a phrase has at most {K} words")
    listed = spark.createDataFrame(rows, "template int, text string, label string, phrase boolean").withColumn("words", words_of(F.col("text")))
    k = F.least(F.size("words"), F.lit(K))
    two, three = runs(F.col("words"))
    n = F.size("words") - k + 1
    listed = listed.withColumn("k", k).withColumn("n_runs", n)
    listed = listed.select("template", "label", "phrase", "k", "n_runs", "words", F.posexplode(F.slice(F.when(k == 2, two).otherwise(three), 1, n)).alias("at", "hash"))
    listed = listed.select("hash", "template", "at", F.expr("slice(words, at + 1, k)").alias("run"), "label", "phrase", "n_runs")
    others = F.size(F.collect_set("label").over(Window.partitionBy("hash")))
    listed = listed.withColumn("telling", others == 1)
    everywhere = spark.createDataFrame([(_EVERY, -1, 0, None, None, False, 0, False)], listed.schema)
    return listed.unionByName(everywhere)


_EVERY = 0


def hits(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """All places (row, doc_id, n_words, template, at, place, ...) where a run of a template stands; template -1 once for each text."""
    listed = template_runs(docs.sparkSession, phrases, templates)
    rows = docs.select("doc_id", words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("two", F.expr("zip_with(one, slice(one, 2, n_words), (a, b) -> xxhash64(a, b))"))
    rows = rows.withColumn("all", F.concat(F.array(F.lit(_EVERY).cast("long")), F.col("two"), F.expr("zip_with(two, slice(one, 3, n_words), (a, b) -> xxhash64(a, b))")))
    rows = rows.select("row", "doc_id", "n_words", "words", F.posexplode("all").alias("i", "hash"))
    found = rows.join(F.broadcast(listed) if len(phrases) + len(templates) <= BROADCAST_TEMPLATES else listed.hint("merge"), "hash")
    place = F.when(F.col("template") < 0, 0).otherwise((F.col("i") - 1) % F.greatest("n_words", F.lit(1))).cast("int")
    found = found.withColumn("place", place).where("template < 0 or slice(words, place + 1, size(run)) = run")
    return found.select("row", "doc_id", "n_words", "template", "label", "phrase", "n_runs", "telling", "at", "place", F.size("run").alias("k"))


def spans(found: DataFrame, slack: int = SLACK, covered: float = COVERED) -> DataFrame:
    """Verified spans (row, label, first, last, share) of the templates that are not phrases."""
    votes = found.where("template >= 0 and not phrase").withColumn("diagonal", F.col("place") - F.col("at"))
    votes = votes.groupBy("row", "template", "label", "n_runs", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max(F.col("place") + F.col("k") - 1).alias("last"), F.max("telling").alias("telling"))
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > slack, F.lit(True)).cast("int")
    merged = votes.withColumn("apart", apart).withColumn("group", F.sum("apart").over(own))
    merged = merged.groupBy("row", "template", "label", "n_runs", "group").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("telling").alias("telling"))
    share = F.least(F.col("votes") / F.col("n_runs"), F.lit(1.0))
    long_enough = F.col("last") - F.col("first") + 1 <= 1.5 * (F.col("n_runs") + K) + slack
    return merged.withColumn("share", share).where((F.col("share") >= covered) & long_enough & F.col("telling")).select("row", "label", "first", "last", "share")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    found = materialise(hits(docs, phrases, templates), "license-hits")
    base = lambda c: F.when(F.col("phrase"), F.col(c))
    rows = found.groupBy("row").agg(
        F.max(F.struct("doc_id", "n_words")).alias("doc"), F.count(base("place")).alias("n_base"),
        F.min(base("place")).cast("long").alias("first_word"), F.max(base("place")).cast("long").alias("last_word"), F.collect_set(base("label")).alias("base"),
    )
    verified = spans(found).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = lambda c: F.concat_ws(",", F.array_sort(c))
    rows = rows.join(verified, "row", "left")
    every = F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select("doc.doc_id", "doc.n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))
