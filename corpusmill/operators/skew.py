"""Per-key results when a few keys hold most of the rows.

Both inputs are reduced by the join key before they meet, so the join sees one compact state per
(join key, group) instead of raw rows; counts of one side then multiply the sums of the other, and a
last small aggregation rolls the states up to the group. No stage is partitioned by the hot group
until it has been reduced to one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import owner_key


def eager_join_aggregate(
    facts: DataFrame,
    measures: DataFrame,
    key: str,
    groups: list[str],
    measure: str,
    count_as: str = "n_rows",
    sum_as: str = "total",
) -> DataFrame:
    """``groups``, count of ``facts`` rows and sum of ``measure`` over facts LEFT JOIN measures USING (key).

    ``measures`` may hold several rows of a key; each contributes, as in the plain join's sum, while
    ``count_as`` counts the rows of ``facts`` alone. Null keys join nothing but are counted. A group
    none of whose keys has a measure gets a null sum. Empty inputs give an empty result.
    """
    states = facts.groupBy(F.col(key).alias("_key"), *groups).agg(F.count(F.lit(1)).alias("_n"))
    sums = measures.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sum(F.col(measure).cast("long")).alias("_sum"))
    joined = states.join(sums, "_key", "left")
    return joined.groupBy(*groups).agg(
        F.sum("_n").alias(count_as),
        F.sum(F.col("_n") * F.col("_sum")).alias(sum_as),
    )


def distinct_mappings(repository_source: DataFrame) -> DataFrame:
    """Distinct stored rows with the owner's common spelling beside them.

    The shuffle is on all four columns, so no owner can overload one task.
    """
    return repository_source.select("owner", "name", "hash", "path").distinct().withColumn("owner", owner_key("owner"))


def repository_totals(repository_source: DataFrame, source_summary: DataFrame) -> DataFrame:
    """owner, name, n_mappings, n_tokens of every repository.

    Duplicate rows of either table count once. A hash with several different positive token counts
    takes the largest; null and zero counts say nothing. ``n_tokens`` is 0 where nothing is known.
    """
    known = source_summary.where("n_tokens > 0").groupBy("hash").agg(F.max("n_tokens").alias("n_tokens"))
    totals = eager_join_aggregate(distinct_mappings(repository_source), known, "hash", ["owner", "name"], "n_tokens", "n_mappings", "n_tokens")
    return totals.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))


def heavy_repositories(totals: DataFrame, share: float | Column = 0.02) -> DataFrame:
    """Repositories that hold at least ``share`` of all mappings, with their totals."""
    everything = totals.agg(F.sum("n_mappings")).scalar()
    return totals.where((F.col("n_mappings") >= share * everything) & (F.col("n_tokens") >= 0))
