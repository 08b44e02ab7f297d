"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import splits
from corpusmill.sources.tables import read


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    mappings = read(spark, d, "repository_source").select("owner", "name", "hash", "path").distinct()
    return splits.assign_splits(splits.owner_components(mappings), F.col("component"))


def recorded_sets(spark: SparkSession, d: str) -> DataFrame:
    """hash, set_name: the sets in which a hash has results."""
    results = read(spark, d, "result", "good_file", "partition").where("partition IS NOT NULL AND good_file IS NOT NULL")
    names = read(spark, d, "partition_set")
    return results.distinct().join(F.broadcast(names), "partition").select(F.col("good_file").alias("hash"), "set_name").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken_components(_assigned(spark, d), recorded_sets(spark, d), "hash").select(F.col("component").alias("owner"))


def p1_moves(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken_components(_assigned(spark, d), recorded_sets(spark, d), "hash").select(F.col("component").alias("owner"), "split", "n_sets", "n_moved")


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    return splits.balance_report(_assigned(spark, d))


QUERIES = {"p1_found": p1_found, "p1_moves": p1_moves, "p1_balance": p1_balance}

ORACLES = {
    "p1_found": """
      WITH own AS (
        SELECT hash, min(lower(trim(owner))) AS owner FROM repository_source
        GROUP BY hash HAVING count(DISTINCT lower(trim(owner))) = 1)
      SELECT own.owner AS owner
      FROM own JOIN result r ON r.good_file = own.hash JOIN partition_set p ON p.partition = r.partition
      GROUP BY own.owner HAVING count(DISTINCT p.set_name) > 1
    """,
}
