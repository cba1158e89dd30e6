"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, fertility, fill_middle, jaccard_join, language, lm_trie, lookup_sketch, packing, quality, repeats, secret_ledger, token_count
from .frames import table

TOKENIZER = "word_bpe_49k.json"
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")


def held_out(mod: int, rest: int) -> Column:
    """Whether the CRC-32 of the id as text has this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.score_documents(table(spark, sf_dir, "documents"), held_out(7, 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out(5, 0)))
    return language.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "n_spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=4096, end_id=1)


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(5, 0), threshold=0.3)


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secret_scan(table(spark, sf_dir, "documents"))


def op10_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"), [public_tokenizers.path(v) for v in VOCABULARIES])


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_decontamination": op6_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_scores": op8_quality_scores,
    "op9_secret_ledger": op9_secret_ledger,
    "op10_lookup_sketch": op10_lookup_sketch,
    "op11_fill_middle": op11_fill_middle,
    "op12_fertility_rules": op12_fertility_rules,
    "op13_source_audit": op13_source_audit,
}

# Queries that SQL can express and run over whole tables; tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op11_fill_middle": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), asked AS (
            SELECT *,
                CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
                CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS share, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS turn
            FROM texts
        ), formed AS (
            SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
                CASE WHEN n = 0 OR share >= 90 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') THEN 'plain'
                    WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM asked
        ), made AS (
            SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle, substr(body, b + 1, n - b) AS suffix FROM formed
        )
        SELECT doc_id, n, form,
            CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN body
                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
            sha256(body) AS restored_sha256
        FROM made
    """,
    "op13_source_audit": """
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ), words AS (
            SELECT d, lang, source, unnest(regexp_extract_all(body, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM docs
        ), kept AS (
            SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3
        ), vocabulary AS (
            SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(c) AS HUGEINT) AS n FROM kept GROUP BY lang
        ), sources AS (
            SELECT DISTINCT lang, source FROM docs
        ), counts AS (
            SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), totals AS (
            SELECT lang, source, coalesce(sum(counts.c), 0) AS n FROM sources LEFT JOIN counts USING (lang, source) GROUP BY lang, source
        ), cells AS (
            SELECT lang, source, term, coalesce(counts.c, 0) AS c,
                1 + CAST(1000000000 AS HUGEINT) * (coalesce(counts.c, 0) + 1) // CAST(totals.n + v AS HUGEINT) AS p,
                1 + CAST(1000000000 AS HUGEINT) * (kept.c + 1) // (vocabulary.n + v) AS q
            FROM totals JOIN vocabulary USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM cells AS a JOIN cells AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
            FROM sources AS a JOIN sources AS b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM cells WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
            FROM parts
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
