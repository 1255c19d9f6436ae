"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from . import leaks, markup, names, quality, sentences, split, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_requests(table(spark, d, "requests"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.boundaries(p1_pieces(spark, d))


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spelled = names.distinct_names([table(spark, d, "mentions").select("text", "entity_type"), table(spark, d, "gold_names").select("name", "entity_type")])
    spelled = cut_lineage(spelled)
    return spelled, cut_lineage(names.link_names(spelled))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return names.stars(*_linked(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.star_pairs(p3_members(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_found(table(spark, d, "sentences"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    out = markup.clean_sentences(table(spark, d, "sentences"))
    return out.select("sentence_id", "clean_text", "block", F.size("codes").alias("n_codes"), F.size("formulas").alias("n_formulas"), F.array_join("clean_path", " > ").alias("clean_path"))


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    return markup.region_kinds(table(spark, d, "masked_regions"), table(spark, d, "documents"))


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_texts(table(spark, d, "chunks"), "chunk_id", "text", "lang")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_sentences(spark, d).select("chunk_id", "start_char", "end_char").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where(F.col("kind") == "exact").select("doc_id", "item_id")


def _languages(spark: SparkSession, d: str) -> dict[str, quality.Language]:
    """Language profiles from a bounded sample of the labelled prose of ``chunks``."""
    return quality.fit_languages(quality.language_sample(table(spark, d, "chunks")))


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_stats(table(spark, d, "documents"), _languages(spark, d))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts alone, which need no Python."""
    rows = quality.text_counts(table(spark, d, "documents"))
    ratios = ("mean_word_length", "symbol_ratio", "stopped_line_share", "common_word_share")
    return rows.select("doc_id", "n_chars", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in ratios])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = quality.text_kinds(table(spark, d, "documents"), _languages(spark, d))
    return kinds.where(F.col("text_kind").isin("table", "list", "junk")).select("doc_id", "text_kind").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_members, p4_found, p4_clean, p4_regions, p6_found, p6_sentences, p7_ids, p8_found, p8_report, p9_found, p9_stats, p9_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH last AS (
              SELECT request_id, text, section_chars, input_tokens, max_input_tokens,
                     row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC, text DESC) AS rn
              FROM requests),
            lim AS (
              SELECT request_id, text, length(text) AS n,
                     CASE WHEN section_chars IS NULL OR section_chars <= 0 THEN 3000 ELSE section_chars END AS own,
                     CASE WHEN input_tokens > max_input_tokens THEN (length(text) * max_input_tokens) // input_tokens END AS host
              FROM last WHERE rn = 1 AND text IS NOT NULL),
            long AS (SELECT request_id, text, n, CASE WHEN host < own THEN host ELSE own END AS most FROM lim),
            atoms AS (
              SELECT request_id, most, unnest(regexp_extract_all(text, '[^ \\t\\r\\n。！？]*[ \\t\\r\\n。！？]|[^ \\t\\r\\n。！？]+')) AS atom
              FROM long WHERE n > most)
            SELECT request_id, CASE WHEN max(length(atom)) > max(most) THEN 'forced' ELSE 'natural' END AS boundary
            FROM atoms GROUP BY request_id
        """,
        "p9_counts": f"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            c AS (
              SELECT doc_id, length(text) AS n_chars, regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*') AS words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]')) AS letters,
                     len(regexp_extract_all(text, '[^\\p{{L}}\\p{{M}}\\p{{N}} \\t\\n\\v\\f\\r]')) AS signs, len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]')) AS visible,
                     list_filter(regexp_split_to_array(text, '[\\r\\n\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_matches(x, '[^ \\t\\v\\f]')) AS lines
              FROM t),
            n AS (
              SELECT *, len(list_filter(words, lambda w: w IN ({", ".join("'" + w + "'" for w in sorted(quality.COMMON))}))) AS common,
                     len(list_filter(lines, lambda x: regexp_matches(x, '[.!?。！？।።؟…]["''”’»«)\\]}}*_`~$> \\t\\v\\f]*$'))) AS stopped
              FROM c)
            SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
                   round(coalesce(letters / nullif(len(words), 0), 0), 6) AS mean_word_length, round(coalesce(signs / nullif(visible, 0), 0), 6) AS symbol_ratio,
                   round(coalesce(stopped / nullif(len(lines), 0), 0), 6) AS stopped_line_share, round(coalesce(common / nullif(len(words), 0), 0), 6) AS common_word_share
            FROM n
        """,
        "p4_regions": """
            SELECT DISTINCT r.document_id, r.region_no, r.start_char,
                   CAST(coalesce(r.end_char, length(d.text)) AS INTEGER) AS end_char,
                   CASE WHEN lower(trim(r.kind)) IN ('code', 'fence', 'fenced') THEN 'fence'
                        WHEN lower(trim(r.kind)) IN ('table', 'math', 'comment', 'frontmatter') THEN lower(trim(r.kind))
                        ELSE 'unknown' END AS region_kind
            FROM masked_regions r LEFT JOIN documents d ON r.document_id = d.document_id
        """,
    }
