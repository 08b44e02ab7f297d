"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import truncation
from corpusmill.sources.tables import read


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(_documents(spark, d)).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_documents(spark, d))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.hidden_limits(truncation.inspected(_documents(spark, d)))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates, "p10_limits": p10_limits}
ORACLES: dict[str, str] = {}
