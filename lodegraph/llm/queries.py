"""The queries of the text and training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import leaks, pii, provenance, secrets, syntax, tokenize, topn
from lodegraph.runtime import load, materialize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_symbols(load(spark, d, "high_value_symbols"), 3).select("file_path", "symbol_id")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_symbols(load(spark, d, "high_value_symbols"), 10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    labels = provenance.label_files(load(spark, d, "manifest_files"), load(spark, d, "upstream_files"))
    return labels.where(F.col("label") != "handwritten").select("file_id")


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_files(load(spark, d, "manifest_files"), load(spark, d, "upstream_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(load(spark, d, "manifest_files")).select("file_id", "line_no")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_credentials(load(spark, d, "manifest_files").select("file_id", "source_text")).select("file_id", "redacted_text")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "manifest_files")
    found = materialize(secrets.find_credentials(files), "credentials")
    return secrets.report_coverage(found, files, load(spark, d, "ingestion_results"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.find_unparsable(load(spark, d, "manifest_files")).select("file_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "manifest_files")
    return syntax.parse_rates(syntax.find_unparsable(files), files, load(spark, d, "ingestion_results"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.decode_corpus(tokenize.encode_corpus(load(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_items")
    return leaks.leak_report(leaks.leaked_items(load(spark, d, "documents"), items), items)


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """As p9_found, but passages of the same length within two edits count as well."""
    return leaks.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"), max_edits=2)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mention_lines(pii.find_personal_data(load(spark, d, "documents")))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    found = materialize(pii.find_personal_data(docs), "found")
    return pii.replace_personal_data(docs, found)


def p10_surrogates(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    found = materialize(pii.find_personal_data(docs), "found")
    return pii.replace_personal_data(docs, found, secret="demonstration key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_ranked, p3_found, p3_labels, p4_found, p4_redacted, p4_report, p7_found, p7_rates, p8_ids, p8_decoded, p9_found, p9_items, p9_near, p10_found, p10_redacted, p10_surrogates)}


_CURRENT_SYMBOLS = """
WITH latest AS (
  SELECT symbol_id, file_path, symbol_name, centrality_score,
         row_number() OVER (PARTITION BY symbol_id ORDER BY computed_at DESC) AS r
  FROM high_value_symbols),
ranked AS (
  SELECT file_path, symbol_id, symbol_name, centrality_score,
         CAST(row_number() OVER (PARTITION BY file_path ORDER BY centrality_score DESC, symbol_name, symbol_id) AS INTEGER) AS rank_no
  FROM latest WHERE r = 1 AND centrality_score IS NOT NULL AND NOT isnan(centrality_score))
"""
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


_LEAKED = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items WHERE item_text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[n:n + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS n FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[n:n + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS n FROM i WHERE len(w) >= 12)),
leaked AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CURRENT_SYMBOLS + "SELECT file_path, symbol_id FROM ranked WHERE rank_no <= 3",
        "p1_ranked": _CURRENT_SYMBOLS + "SELECT symbol_id, file_path, symbol_name, centrality_score, rank_no FROM ranked WHERE rank_no <= 10",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p9_found": _LEAKED + " SELECT doc_id, item_id FROM leaked",
        "p9_items": _LEAKED + " SELECT item_id, suite, (SELECT count(*) FROM leaked l WHERE l.item_id = e.item_id) AS document_count FROM (SELECT DISTINCT item_id, suite FROM eval_items) e",
    }
