"""Source files that do not parse.

Each source is parsed in the language of its path by a recursive-descent parser with
precedence-climbing expressions (``parsers``). A parser goes on after an error in panic mode, so all
errors of a file are stored, with the first one as its cause. A source is parsed once for each
language it occurs under, however many mappings it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.parsers import java8, javascript, python3
from corpusmill.runtime import beside, spread

CHECKS = {"python": python3.check, "javascript": javascript.check, "java": java8.check}
VERDICT = "hash string, language string, errors array<struct<line:int,message:string>>"


def language_of(path: str | Column) -> Column:
    """python, javascript or java by the ending of a path, in any case; null for all others."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return F.when(p.endswith(".py"), "python").when(p.endswith(".js"), "javascript").when(p.endswith(".java"), "java")


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, source, languages in zip(frame["hash"], frame["source"], frame["languages"]):
            for language in languages:
                errors = CHECKS[language](bytes(source or b""))
                if errors:
                    rows.append((key, language, [{"line": line, "message": message} for line, message in errors]))
        yield pd.DataFrame(rows, columns=["hash", "language", "errors"])


def files_by_language(repository_source: DataFrame) -> DataFrame:
    """Distinct mappings of the three languages."""
    return repository_source.select("owner", "name", "hash", "path").distinct().withColumn("language", language_of("path")).where("language IS NOT NULL")


def broken_sources(files: DataFrame, source_file: DataFrame) -> DataFrame:
    """hash, language, errors: the sources that do not parse in a language they occur under.

    Null sources count as empty, which parse. Mappings without a source row are not judged; repeated
    rows of either table count once.
    """
    wanted = files.where("hash IS NOT NULL").groupBy("hash").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    parsed = beside(spread(source_file.select("hash", "source"), "hash"), wanted, "hash").mapInPandas(_parse, VERDICT)
    return parsed.dropDuplicates(["hash", "language"])


def broken_files(repository_source: DataFrame, source_file: DataFrame) -> DataFrame:
    """owner, name, hash, path, language, errors, cause of every mapping whose source does not parse."""
    files = files_by_language(repository_source)
    return files.join(broken_sources(files, source_file), ["hash", "language"]).select(
        "owner", "name", "hash", "path", "language", "errors", F.col("errors")[0]["message"].alias("cause")
    )


def acceptance(repository_source: DataFrame, source_file: DataFrame, failure: DataFrame) -> DataFrame:
    """owner, name, language, n_files, n_broken, n_recorded, rate: per repository and language, over
    files that have a source row; n_recorded of the broken ones are in ``failure`` as well."""
    files = files_by_language(repository_source)
    bad = broken_sources(files, source_file).select("hash", "language", F.lit(True).alias("_bad"))
    there = source_file.select("hash").distinct()
    recorded = failure.select("hash", F.lit(True).alias("_recorded")).distinct()
    joined = files.join(there, "hash", "left_semi").join(bad, ["hash", "language"], "left").join(recorded, "hash", "left")
    return joined.groupBy("owner", "name", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("_bad").alias("n_broken"),
        F.count(F.when(F.col("_bad"), F.col("_recorded"))).alias("n_recorded"),
    ).withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
