"""One query per operator over its whole table, the pipeline, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from seafret.llm import (
    bpe, decontaminate, exact_dedup, fill_middle, html_text, langid, lexical_search, licenses, line_dedup, quality, simhash, toxicity,
    unigram_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe_codec")
def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: a source is taken for a repository, a language for a directory in it."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", path))


@query("op4_unigram_token_counts")
def unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query(
    "op7_line_dedup",
    """
    WITH l AS (
        SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM documents
    ), b AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 5)
    SELECT d.doc_id,
           CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE b.line IS NULL), '') END AS text,
           count(l.at) AS n_lines, count(b.line) AS n_removed
    FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN b USING (line) GROUP BY d.doc_id, d.text
    """,
)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(table(spark, sf_dir, "documents"))


@query(
    "op8_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
         g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_in_two(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_fill_in_middle",
    r"""
    WITH u AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
               sha256('1:' || doc_id) AS hexed
        FROM documents
    ), h AS (
        SELECT *, len(units) AS n, ('0x' || hexed[1:8])::BIGINT AS h1, ('0x' || hexed[9:16])::BIGINT AS h2,
               ('0x' || hexed[17:24])::BIGINT AS h3, ('0x' || hexed[25:32])::BIGINT AS h4
        FROM u
    ), c AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM h
    ), p AS (
        SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
               array_to_string(units[b + 1:], '') AS suffix
        FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@query(
    "op13_lexical_search",
    r"""
    WITH t AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
    l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
    s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
    f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    i AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), w AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM i JOIN f USING (term), s),
    m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // total AS m FROM l, s),
    r AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM w JOIN c USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM r WHERE score > 0 QUALIFY rank <= 10
    """,
)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
