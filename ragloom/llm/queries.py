"""Queries of the training-text operators, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import documented, leakage, linkage_queries, piece_queries, provenance, ranking_queries, scans, spam, syntax, tokenize
from ragloom.runtime import table


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file that nobody wrote by hand, with the reasons."""
    return provenance.not_hand_written(table(spark, sf_dir, "code_file")).select("file_path", F.concat_ws(",", "kinds").alias("kinds"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, sf_dir, "code_file")).select("file_path")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise_of(table(spark, sf_dir, "pdf_page"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "pdf_page"))


def p2_chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of the PDF items of doc_chunk, whose windows are put together to pages first."""
    return scans.paragraphs(scans.pages_of_chunks(table(spark, sf_dir, "doc_chunk").where("format = 'pdf'")))


def p4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of errors, first line, first cause and all errors of every stored file."""
    return syntax.verdicts(table(spark, sf_dir, "code_file")).withColumn("errors", F.to_json("errors"))


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors, a row for each."""
    rows = syntax.verdicts(table(spark, sf_dir, "code_file")).select("file_path", "repo", "language", F.explode("errors").alias("e"))
    return rows.select("file_path", "repo", "language", "e.line", "e.cause")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.verdicts(table(spark, sf_dir, "code_file")).where("n_errors > 0").select("file_path").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(syntax.verdicts(table(spark, sf_dir, "code_file")))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.pairs(table(spark, sf_dir, "code_chunk"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.pairs(table(spark, sf_dir, "code_chunk"), with_code=False).select("file_path", "func_name")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and re-parameterised leaks, with the number of the item's windows."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_item"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("kind = 'exact'").select("item_id", "doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.rate(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("spam").select("doc_id")


_WINDOWS = r"""
WITH w AS (
  SELECT {key}, list_filter(string_split_regex(lower(regexp_replace(text, '\p{{Cf}}', '', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
  FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)
SELECT DISTINCT {key}, array_to_string(w[i:i+11], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_paragraphs, p2_chunk_paragraphs, p4_found, p4_verdicts, p4_errors, p4_rates, p7_found, p7_pairs, p8_ids, p9_found, p9_leaks, p10_found, p10_scores)} | ranking_queries.QUERIES | linkage_queries.QUERIES | piece_queries.QUERIES


def oracle_sql() -> dict:
    return {
        "p9_found": "SELECT DISTINCT item_id, doc_id FROM ("
        + _WINDOWS.format(key="item_id", table="test_item")
        + ") a JOIN ("
        + _WINDOWS.format(key="doc_id", table="documents")
        + ") b USING (s)",
    } | ranking_queries.SQL | linkage_queries.SQL | piece_queries.SQL
