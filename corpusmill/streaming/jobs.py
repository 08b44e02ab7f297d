"""The work queue as streams of files.

Putting a job in is writing a file; the checkpoint holds what is in flight and done. Every batch is
written under its own number, replacing what an earlier try of the same batch left, so a job is
delivered at least once and its outcome stored exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import languages


def enqueue(jobs: DataFrame, queue: str) -> None:
    jobs.write.mode("append").parquet(queue)


def jobs_of(spark: SparkSession, queue: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """The queue as a stream; ``files_a_batch`` bounds what is taken at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(queue)


def consume(stream: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, dead: str, checkpoint: str, error: str = "error") -> StreamingQuery:
    """Works off what is there and ends. ``work`` maps a batch to rows with a column ``error``: null rows
    are done, the others go to the dead letters."""

    def run(batch: DataFrame, number: int) -> None:
        worked = work(batch).persist()
        try:
            worked.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(f"{done}/batch={number}")
            worked.where(F.col(error).isNotNull()).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            worked.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry(spark: SparkSession, dead: str, queue: str, keys: list[str]) -> int:
    """Puts every failed job in again, once; the number put in."""
    failed = spark.read.parquet(dead).select(*keys).distinct()
    n = failed.count()
    if n:
        enqueue(failed, queue)
    return n


def parse_batch(batch: DataFrame) -> DataFrame:
    """Summaries of new sources, with the reason of those that do not parse as error."""
    return languages.parsed(batch.dropDuplicates(["hash"])).withColumnRenamed("reason", "error")


def parse_incrementally(spark: SparkSession, queue: str, summaries: str, failures: str, checkpoint: str) -> StreamingQuery:
    """Parses sources (hash, source, language) as they come in."""
    return consume(jobs_of(spark, queue, "hash string, source binary, language string"), parse_batch, summaries, failures, checkpoint)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; events later than ``late`` are left out once their window is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")
