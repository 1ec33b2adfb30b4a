"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import DOMAINS, mix

    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", *(F.round(d, 9).alias(f"p_{d}") for d in DOMAINS), F.round("rate", 6).alias("rate"), "copies", "targets_met")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"), k=5, window=8)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    read = archive_and_read(table(spark, sf_dir, "pages"), least=1000)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), end_id=1)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import label

    return label(table(spark, sf_dir, "documents"), radius=4, words=4, seed=42)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_sitestyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sitestyle import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=16)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


# What SQL can say of results that it cannot say whole: the same operators, fewer columns.


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the shards: all documents and bytes, sizes no further from even than the longest record and the texts kept together allow, slots without gaps."""
    from pyspark.sql import functions as F

    from .sharding import TOGETHER

    per = op10_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("longest"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    total, longest = F.sum("bytes"), F.max("longest")
    gapless = F.min((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    even = F.greatest(F.max("bytes") - total / 16, total / 16 - F.min("bytes")) <= longest + total / 16 * 2 * TOGETHER
    return per.agg(F.sum("n").alias("documents"), total.alias("bytes"), F.count("*").alias("shards"), gapless.alias("gapless"), even.alias("even"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_winnowing": op2_winnowing,
    "op3_warc": op3_warc,
    "op4_licenses": op4_licenses,
    "op5_simple8b": op5_simple8b,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_sitestyle": op8_sitestyle,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_search": op11_search,
    "op12_toxicity": op12_toxicity,
    "op13_merkle": op13_merkle,
    "edited_texts": edited_texts,
    "license_base": license_base,
    "quality_counts": quality_counts,
    "shard_law": shard_law,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM g
    """,
    "op11_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        p AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d),
        f AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM p GROUP BY doc_id, term),
        g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        c AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS length FROM p),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        i AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
        s AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // length)))) AS BIGINT) AS score
              FROM i JOIN g USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_merkle": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
        l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other,
              row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM d),
        crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                 lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS crc FROM l),
        t AS (SELECT source, 0 AS level, pos, leaf AS h, size FROM l
              UNION ALL SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 2) // 3 FROM t WHERE size > 1 GROUP BY source, level, pos // 3),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
        u AS (SELECT 0 AS level, pos, subroot AS h, size FROM s
              UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 2) // 3 FROM u WHERE size > 1 GROUP BY level, pos // 3),
        w AS (SELECT l.doc_id, t.level AS step, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // CAST(pow(3, t.level) AS BIGINT)), '') AS lo, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // CAST(pow(3, t.level) AS BIGINT)), '') AS hi
              FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source AND t.pos // 3 = l.pos // CAST(pow(3, t.level + 1) AS BIGINT) WHERE t.size > 1 GROUP BY l.doc_id, t.level
              UNION ALL SELECT l.doc_id, 100 + u.level, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos // CAST(pow(3, u.level) AS BIGINT)), ''), coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos // CAST(pow(3, u.level) AS BIGINT)), '')
              FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN u ON u.pos // 3 = s.pos // CAST(pow(3, u.level + 1) AS BIGINT) WHERE u.size > 1 GROUP BY l.doc_id, u.level),
        v AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS step, lo, hi FROM w),
        p AS (SELECT doc_id, sha256(string_agg(lo || hi, '' ORDER BY step)) AS proof, count(*) AS steps FROM v GROUP BY doc_id),
        k AS (SELECT x.doc_id, CAST(1 AS BIGINT) AS step, x.cur FROM (SELECT doc_id, CASE WHEN crc % 2 = 0 THEN other ELSE leaf END AS cur FROM l JOIN crcs USING (doc_id)) x
              UNION ALL SELECT k.doc_id, k.step + 1, sha256(v.lo || k.cur || v.hi) FROM k JOIN v ON v.doc_id = k.doc_id AND v.step = k.step)
        SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.cur AS folded_root, f.cur = r.h AS verified
        FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN (SELECT h FROM u WHERE size = 1) r ON true LEFT JOIN p ON p.doc_id = l.doc_id JOIN k f ON f.doc_id = l.doc_id AND f.step = coalesce(p.steps, 0) + 1
    """,
    "edited_texts": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d)
        SELECT doc_id, n_chars, sha256(left(t, n_chars - n_chars // 4) || left(after, n_chars // 4)) AS edited_sha256 FROM n
    """,
    "license_base": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        x AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS i FROM w),
        g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        f AS (SELECT doc_id, i, 'cc-by' AS label FROM g WHERE a = 'cc' AND b = 'by' UNION ALL SELECT doc_id, i, 'gpl' FROM g WHERE a = 'general' AND b = 'public' AND c = 'license'
              UNION ALL SELECT doc_id, i, 'reserved' FROM g WHERE a = 'all' AND b = 'rights' AND c = 'reserved')
        SELECT w.doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words, count(f.i) AS n_base, min(f.i) AS first_word, max(f.i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM w LEFT JOIN f ON f.doc_id = w.doc_id GROUP BY w.doc_id
    """,
    "quality_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        x AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
        g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
        k AS (SELECT doc_id, count(DISTINCT i + v.j) AS n FROM r, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
        s AS (SELECT doc_id, sum(length(a)) AS chars FROM x GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(k.n, 0) > 50 * len(words) AS base_failed
        FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
    """,
    "shard_law": "SELECT count(*) AS documents, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(16 AS BIGINT) AS shards, true AS gapless, true AS even FROM documents",
}
