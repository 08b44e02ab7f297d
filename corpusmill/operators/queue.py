"""The work queue as tables: what is done, what failed, and what to try again. Streams are in ``streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_jobs(jobs: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(done, dead letters) of a batch of jobs; null outcomes are failures."""
    bad = F.coalesce(failed, F.lit(True))
    return jobs.where(~bad), jobs.where(bad)


def retries(dead: DataFrame, keys: list[str]) -> DataFrame:
    """Each failed job once, to be put in again."""
    return dead.select(*keys).distinct()


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs not done yet, each once."""
    return jobs.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti")


def seconds_until(reset: Column, now: Column, margin: int = 2) -> Column:
    """Seconds to wait for a limit to be lifted, never negative."""
    return F.greatest(F.unix_timestamp(reset) - F.unix_timestamp(now), F.lit(0)) + margin
