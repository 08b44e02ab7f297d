"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import neardup
from corpusmill.sources.tables import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_sources(read(spark, d, "source_file"), 0.5).select("hash_a", "hash_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(read(spark, d, "source_file"), 0.5)


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLES: dict[str, str] = {}
