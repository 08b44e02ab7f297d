"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import overlap
from corpusmill.llm.q_splits import recorded_sets
from corpusmill.sources.tables import read


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(read(spark, d, "source_file"), recorded_sets(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("set_name", "hash_a", "hash_b")


def p5_edits(spark: SparkSession, d: str) -> DataFrame:
    return overlap.edits(_overlaps(spark, d), read(spark, d, "source_file"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, d), read(spark, d, "repository_source"))


QUERIES = {"p5_found": p5_found, "p5_edits": p5_edits, "p5_report": p5_report}
ORACLES: dict[str, str] = {}
