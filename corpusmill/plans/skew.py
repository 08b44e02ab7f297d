"""Queries on the repositories that hold most of the mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import skew
from corpusmill.sources.tables import read


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.repository_totals(read(spark, d, "repository_source"), read(spark, d, "source_summary", "hash", "n_tokens"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_repositories(_totals(spark, d), 0.02).select("owner", "name")


def p4_repository_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)


_TOTALS_SQL = """
  SELECT lower(trim(m.owner)) AS owner, m.name AS name, count(*) AS n_mappings,
         CAST(coalesce(sum(s.n_tokens), 0) AS BIGINT) AS n_tokens
  FROM (SELECT DISTINCT owner, name, hash, path FROM repository_source) m
  LEFT JOIN (SELECT hash, max(n_tokens) AS n_tokens FROM source_summary WHERE n_tokens > 0 GROUP BY hash) s
    ON m.hash = s.hash
  GROUP BY 1, 2
"""

QUERIES = {"p4_found": p4_found, "p4_repository_totals": p4_repository_totals}

ORACLES = {
    "p4_repository_totals": _TOTALS_SQL,
    "p4_found": f"""
      WITH t AS ({_TOTALS_SQL})
      SELECT owner, name FROM t WHERE n_mappings >= 0.02 * (SELECT sum(n_mappings) FROM t)
    """,
}
