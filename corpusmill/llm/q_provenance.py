"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import provenance
from corpusmill.sources.tables import read


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    files = provenance.judged_files(read(spark, d, "repository_source"), read(spark, d, "source_file"))
    return files.where("reason IS NOT NULL").select("owner", "name", "hash", "path")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return provenance.report(read(spark, d, "repository_source"), read(spark, d, "source_file"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES: dict[str, str] = {}
