"""Mistakes: pairs of sources before and after a fix, their token distance and the edit between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import languages
from corpusmill.operators.sequence import edit_line, string_distance, with_single_fix

KEYS = ["source_file_id", "before_id"]
_LEXED = "source_file_id bigint, before_id bigint, before array<string>, after array<string>, lines array<int>"


def lexed(mistakes: DataFrame, language: str = "java", abstract: bool = False) -> DataFrame:
    """Keys, before, after and the lines of the tokens before; tokens by value, or with ``abstract`` by
    vocabulary entry. Null sources count as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang = languages.language(language)
        text = (lambda t: lang.entry(t)) if abstract else (lambda t: f"{t.name} {t.value}")
        for frame in frames:
            before = [lang.tokenise(bytes(s or b"")) for s in frame["before"]]
            after = [lang.tokenise(bytes(s or b"")) for s in frame["after"]]
            yield pd.DataFrame(
                {
                    **{k: frame[k] for k in KEYS}, "before": [[text(t) for t in ts] for ts in before], "after": [[text(t) for t in ts] for ts in after],
                    "lines": [[t.line for t in ts] for ts in before],
                }
            )

    return mistakes.select(*KEYS, "before", "after").mapInPandas(run, _LEXED)


def _numbered(tokens: Column, table: Column) -> Column:
    return F.transform(tokens, lambda t: F.array_position(table, t).cast("int"))


def as_characters(numbers: Column) -> Column:
    """One private character for each number, so that a distance of strings is one of tokens."""
    return F.array_join(F.transform(numbers, lambda n: F.decode(F.unhex(F.lpad(F.hex(n + F.lit(0x100000)), 8, "0")), "UTF-32")), "")


def distances(pairs: DataFrame) -> DataFrame:
    """source_file_id, before_id, levenshtein of lexed pairs."""
    return _numbers(pairs).select(*KEYS, string_distance(as_characters(F.col("a")), as_characters(F.col("b"))).alias("levenshtein"))


def _numbers(pairs: DataFrame) -> DataFrame:
    table = pairs.withColumn("table", F.array_distinct(F.concat("before", "after")))
    return table.withColumn("a", _numbered(F.col("before"), F.col("table"))).withColumn("b", _numbered(F.col("after"), F.col("table")))


def edits(pairs: DataFrame) -> DataFrame:
    """source_file_id, before_id, line_no, fix, fix_index, mistake, mistake_index, old_token, new_token of
    the pairs one edit apart; the mistake is the fix undone."""
    fixed = with_single_fix(_numbers(pairs), "a", "b")
    name = lambda code: F.when(code == "i", "insertion").when(code == "x", "deletion").otherwise("substitution")
    code = F.col("code")
    rows = fixed.select(*KEYS, "table", edit_line(F.col("lines"), F.col("fix")).alias("line_no"), F.inline(F.array_compact(F.array("fix"))))
    return rows.select(
        *KEYS, "line_no", name(code).alias("fix"), F.col("index").alias("fix_index"), name(F.when(code == "i", "x").when(code == "x", "i").otherwise("s")).alias("mistake"),
        F.col("index").alias("mistake_index"), F.get("table", F.col("original") - 1).alias("old_token"), F.get("table", F.col("token") - 1).alias("new_token"),
    )


def eligible(mistakes: DataFrame, distance: DataFrame) -> DataFrame:
    """Mistakes one edit away from their fix."""
    return mistakes.join(distance.where("levenshtein = 1").select(*KEYS), KEYS, "left_semi")
