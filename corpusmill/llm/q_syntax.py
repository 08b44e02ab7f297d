"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import syntax
from corpusmill.sources.tables import read


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(read(spark, d, "repository_source"), read(spark, d, "source_file")).select("owner", "name", "hash", "path")


def p7_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return syntax.acceptance(read(spark, d, "repository_source"), read(spark, d, "source_file"), read(spark, d, "failure"))


QUERIES = {"p7_found": p7_found, "p7_acceptance": p7_acceptance}
ORACLES: dict[str, str] = {}
