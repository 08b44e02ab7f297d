"""Queries that lex or check source code; tests hold them against small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import languages
from corpusmill.runtime import beside, spread
from corpusmill.sources.tables import read


def _sources(spark, d):
    """Sources with each language they occur under. Mappings are reduced before they meet the sources,
    which are not shuffled where the count of hashes allows it."""
    named = read(spark, d, "repository_source", "hash", "path").select("hash", languages.language_of(F.col("path")).alias("language")).where("hash IS NOT NULL AND language IS NOT NULL").distinct()
    return beside(spread(read(spark, d, "source_file"), "hash").dropDuplicates(["hash"]), named, "hash")


def parse_sources(spark, d):
    return languages.parsed(_sources(spark, d))


def java_vocabulary(spark, d):
    return languages.entry_counts(_sources(spark, d).where("language = 'java'"), "java")


def javascript_vocabulary(spark, d):
    return languages.entry_counts(_sources(spark, d).where("language = 'javascript'"), "javascript")


def recorded_verdicts(spark, d):
    """language, n_parsed, n_failed, n_recorded_failures, n_recorded_summaries: verdicts against the tables."""
    verdicts = parse_sources(spark, d)
    failed = read(spark, d, "failure", "hash").distinct().withColumn("f", F.lit(True))
    done = read(spark, d, "source_summary", "hash").distinct().withColumn("s", F.lit(True))
    return verdicts.join(failed, "hash", "left").join(done, "hash", "left").groupBy("language").agg(
        F.count_if(F.col("reason").isNull()).alias("n_parsed"), F.count("reason").alias("n_failed"), F.count_if(F.col("reason").isNotNull() & F.col("f")).alias("n_recorded_failures"), F.count_if(F.col("reason").isNull() & F.col("s")).alias("n_recorded_summaries")
    )


def unescaped_texts(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", languages.unescape_unicode("text").alias("text"))


QUERIES = {f.__name__: f for f in (parse_sources, java_vocabulary, javascript_vocabulary, recorded_verdicts, unescaped_texts)}
ORACLES: dict[str, str] = {}
