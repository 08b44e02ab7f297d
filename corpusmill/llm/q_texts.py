"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, passages
from corpusmill.sources.tables import read


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return passages.leaked(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "benchmark", "item_id", "text"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return passages.leak_report(p9_found(spark, d), read(spark, d, "benchmark"))


QUERIES = {"p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items}
_GRAMS = """(SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS g FROM (
    SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (
      SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL)))"""
_LEAKS = f"SELECT DISTINCT d.doc_id, b.item_id FROM {_GRAMS.format(key='doc_id', table='documents')} d JOIN {_GRAMS.format(key='item_id', table='benchmark')} b ON d.g = b.g"

ORACLES = {
    "p9_found": _LEAKS,
    "p9_items": f"""WITH l AS ({_LEAKS}), n AS (SELECT item_id, count(*) AS n FROM l GROUP BY item_id)
        SELECT DISTINCT b.item_id, b.suite, b.set_name, coalesce(n.n, 0) AS n_documents FROM benchmark b LEFT JOIN n ON n.item_id = b.item_id""",
}
