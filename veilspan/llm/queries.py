"""The driver's queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, mixing, near_dedup, pieces, pii, quality_model, quality_rules, secret_scan, warc
from .common import table


def _joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        *[_count("base", k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.size("links").cast("long").alias("n_links"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_id(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_model(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.save_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.check_revisits(warc.read_archives(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x.start.alias("start"), x.end.alias("end")))
    return out.withColumn("spans", F.concat("base", terms)).select(
        F.col("id").alias("doc_id"),
        *[_count("base", k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_language_id, op3_exact_dedup, op4_near_dedup, op5_quality_model, op6_warc, op7_quality_rules, op8_pieces, op9_pii, op10_mixing)
    return {f.__name__: f for f in found}


_OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
     r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
     m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to,
       true AS verified
FROM w
"""


def _op7_sql() -> str:
    """The counts by unnesting each text's words; the rules from their table."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(quality_rules.STOP_WORDS)))
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0 END)"
    value = {
        "n_words": "n_words", "repeat_percent": ratio("100.0 * n_repeat_words", "n_words"), "mean_word_length": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "words_per_line": ratio("n_words", "n_lines"), "letter_ratio": ratio("n_letters", "word_chars"),
    }

    def fails(rules: tuple[quality_rules.Rule, ...]) -> str:
        tests = [f"{value[r.measure]} < {r.low}" for r in rules if r.low is not None] + [f"{value[r.measure]} > {r.high}" for r in rules if r.high is not None]
        return "(" + " OR ".join(tests) + ")"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
     p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
     k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
     c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM k WHERE n > 1) GROUP BY doc_id),
     m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len([x for x in w if lower(x) IN ({stop})]) AS n_stop_words,
                  length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters
           FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {fails(quality_rules.BASE_RULES)} AS base_failed,
       NOT {fails(quality_rules.BASE_RULES)} AND NOT {fails(quality_rules.RULES)} AS kept
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _OP3_SQL, "op4_near_dedup": _OP4_SQL, "op6_warc": _OP6_SQL, "op7_quality_rules": _op7_sql()}
