"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import licenses
from corpusmill.sources.tables import read


def _files(spark: SparkSession, d: str) -> DataFrame:
    return licenses.file_licenses(read(spark, d, "repository_source"), read(spark, d, "source_file"), read(spark, d, "repository"), read(spark, d, "license_item"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("owner", "name", "hash", "path", "license_id")


def p6_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("owner", "name", "hash", "path", "license_id", "probable", "probability", "agreement")


def p6_repositories(spark: SparkSession, d: str) -> DataFrame:
    return licenses.repository_licenses(read(spark, d, "repository_source"), read(spark, d, "source_file"), read(spark, d, "repository"))


QUERIES = {"p6_found": p6_found, "p6_posteriors": p6_posteriors, "p6_repositories": p6_repositories}
ORACLES: dict[str, str] = {}
