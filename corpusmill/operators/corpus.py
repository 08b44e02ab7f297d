"""Relational operators of a source corpus: eligibility, lookups, totals, gaps and integrity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import beside

DEFAULT_REASON = "Syntax error"
# The endings that belong to a language, as stored, in lower case.
EXTENSIONS = {"java": [".java"], "python": [".py"], "javascript": [".js"]}


def file_hash(source: str | Column) -> Column:
    """SHA-256 of the raw bytes in hexadecimal digits: the identity of a source."""
    return F.sha2(F.col(source) if isinstance(source, str) else source, 256)


def distinct_sources(source_file: DataFrame) -> DataFrame:
    """hash, n_bytes of each distinct source; only lengths are shuffled, never contents."""
    return source_file.select("hash", F.octet_length("source").cast("long").alias("n_bytes")).distinct()


def eligible(source_summary: DataFrame, failure: DataFrame) -> DataFrame:
    """hash, sloc, n_tokens of the summaries with tokens and without a recorded failure."""
    return source_summary.where("n_tokens > 0").distinct().join(failure.select("hash"), "hash", "left_anti")


def eligible_sources(source_file: DataFrame, eligible_: DataFrame) -> DataFrame:
    """hash, source of the eligible ones."""
    return source_file.join(eligible_.select("hash"), "hash", "left_semi")


def sources_with_repository(repository_source: DataFrame, source_file: DataFrame) -> DataFrame:
    """Each mapping with its source."""
    return repository_source.distinct().join(source_file, "hash")


def lookup(table: DataFrame, key: str, value: str | Column) -> DataFrame:
    """Rows whose key is ``value``; the filter reaches the files' statistics."""
    return table.where(F.col(key) == (F.lit(value) if isinstance(value, str) else value))


def require_one(table: DataFrame, key: str, value: str) -> DataFrame:
    """The one row with this key, or KeyError."""
    found = lookup(table, key, value)
    if found.limit(2).count() != 1:
        raise KeyError(value)
    return found


def metadata(meta: DataFrame, key: str) -> str | None:
    """Value of a corpus setting, None if it is not set."""
    row = meta.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def is_unique(repository_source: DataFrame) -> DataFrame:
    """hash, n_mappings, is_unique: whether a source lies in one place only."""
    return repository_source.groupBy("hash").agg(F.count_distinct("owner", "name", "path").alias("n_mappings")).withColumn("is_unique", F.col("n_mappings") == 1)


def href(owner: Column, name: Column, revision: Column, path: Column) -> Column:
    """Address of a file at a revision of its repository."""
    return F.format_string("https://github.com/%s/%s/blob/%s/%s", owner, name, revision, path)


def file_info(source_file: DataFrame, repository_source: DataFrame, repository: DataFrame, source_summary: DataFrame) -> DataFrame:
    """One row per source that has a mapping: any (the least) mapping with its repository, the number of
    mappings, and the summary, null where there is none."""
    repositories = repository.groupBy("owner", "name").agg(F.min(F.struct("revision", "license")).alias("_r"))
    least = repository_source.groupBy("hash").agg(
        F.min(F.struct("owner", "name", "path")).alias("_m"), F.count_distinct("owner", "name", "path").alias("n_mappings")
    ).select("hash", "_m.*", "n_mappings")
    summary = source_summary.groupBy("hash").agg(F.min(F.struct("sloc", "n_tokens")).alias("_s"))
    joined = least.join(source_file.select("hash").distinct(), "hash", "left_semi").transform(lambda t: beside(t, repositories, ["owner", "name"])).join(summary, "hash", "left")
    return joined.select(
        "hash", "owner", "name", "path", "n_mappings", (F.col("n_mappings") == 1).alias("is_unique"), F.col("_r.license").alias("license"),
        href(F.col("owner"), F.col("name"), F.col("_r.revision"), F.col("path")).alias("href"), F.col("_s.sloc").alias("sloc"), F.col("_s.n_tokens").alias("n_tokens"),
    )


def repository_tokens(repository_source: DataFrame, eligible_: DataFrame) -> DataFrame:
    """owner, name, n_tokens: tokens of the eligible files of each repository, duplicates counted."""
    return repository_source.distinct().join(eligible_.select("hash", "n_tokens"), "hash").groupBy("owner", "name").agg(F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"))


def in_repository(repository_source: DataFrame, eligible_: DataFrame, owner: str, name: str) -> DataFrame:
    """Eligible hashes of one repository."""
    here = repository_source.where((F.col("owner") == owner) & (F.col("name") == name)).select("hash").distinct()
    return here.join(eligible_.select("hash"), "hash", "left_semi")


def tokens_of_subset(source_summary: DataFrame, keys: DataFrame) -> DataFrame:
    """n_files, n_tokens over the summaries whose hash is in ``keys`` (repeats there do not matter)."""
    return source_summary.distinct().join(keys.select("hash"), "hash", "left_semi").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"))


def grouped_median(histogram: DataFrame, value: str, n: str) -> Column:
    """Median of grouped data (interval 1) of a histogram, as an aggregate over its rows in one array.

    The histogram has one row per distinct value: it is bounded by the values' range, not by the rows.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).cast("long").alias("v"), F.col(n).cast("long").alias("n"))))
    total = F.sum(F.col(n).cast("long"))
    walked = F.aggregate(
        entries, F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("m"), F.lit(0).cast("long").alias("f")),
        lambda acc, e: F.when(acc["m"].isNotNull(), acc).when(
            acc["below"] + e["n"] > F.floor(total / 2), F.struct(acc["below"].alias("below"), e["v"].alias("m"), e["n"].alias("f"))
        ).otherwise(F.struct((acc["below"] + e["n"]).alias("below"), acc["m"].alias("m"), acc["f"].alias("f"))),
    )
    return walked["m"] - F.lit(0.5) + (total / F.lit(2.0) - walked["below"]) / walked["f"]


def token_statistics(summaries: DataFrame) -> DataFrame:
    """n_files, total, mean, median_grouped and mode (the least of several) of n_tokens."""
    histogram = summaries.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    return histogram.agg(
        F.sum("n").alias("n_files"), F.sum(F.col("n") * F.col("n_tokens")).alias("total"),
        F.round(F.sum(F.col("n") * F.col("n_tokens")) / F.sum("n"), 6).alias("mean"),
        F.round(grouped_median(histogram, "n_tokens", "n"), 6).alias("median_grouped"),
        F.max_by("n_tokens", F.struct("n", -F.col("n_tokens"))).alias("mode"),
    )


def unparsed(source_file: DataFrame, source_summary: DataFrame, failure: DataFrame) -> DataFrame:
    """Hashes that have neither a summary nor a failure."""
    return source_file.select("hash").distinct().join(source_summary.select("hash"), "hash", "left_anti").join(failure.select("hash"), "hash", "left_anti")


def with_ratio(summaries: DataFrame) -> DataFrame:
    """Summaries that have tokens and lines, with ratio = tokens per line."""
    return summaries.where("n_tokens > 0 AND sloc > 0").distinct().withColumn("ratio", F.col("n_tokens") / F.col("sloc"))


def two_class_break(values: DataFrame, column: str, scale: int = 64) -> DataFrame:
    """``break``: the largest value of the lower of two natural classes of log(column), back in its own
    scale: the split with the least sum of squared deviations.

    Prefix sums run in two levels: values fall into buckets of 1/``scale`` of the logarithm; sums of
    whole buckets (bounded by the values' range) are accumulated first, then each bucket's own
    values, so no task sees the whole table. Ties of the deviation go to the smaller value.
    """
    x = F.log(F.col(column))
    each = values.where(F.col(column) > 0).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = each.withColumn("x", F.log("v")).withColumn("b", F.floor(F.col("x") * scale))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q")]
    buckets = each.groupBy("b").agg(*sums)
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over buckets only
    offsets = buckets.select("b", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_{c}") for c in "nsq"))
    within = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = each.join(F.broadcast(offsets), "b").select(
        "v", (F.sum("n").over(within) + F.col("_n")).alias("n"), (F.sum(F.col("n") * F.col("x")).over(within) + F.col("_s")).alias("s"),
        (F.sum(F.col("n") * F.col("x") * F.col("x")).over(within) + F.col("_q")).alias("q"),
    )
    total = buckets.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    tn, ts, tq = (total.select(c).scalar() for c in "nsq")
    low = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    high = (tq - F.col("q")) - (ts - F.col("s")) * (ts - F.col("s")) / (tn - F.col("n"))
    del x
    return running.where(F.col("n") < tn).select("v", F.round(low + high, 9).alias("d")).agg(F.round(F.min_by("v", F.struct("d", "v")), 9).alias("break"))


def minified_by_ratio(summaries: DataFrame) -> DataFrame:
    """hash, ratio, label (gen above the break, hw below it) and the reason to record from the break on."""
    rated = with_ratio(summaries)
    limit = two_class_break(rated, "ratio").scalar()
    return rated.select(
        "hash", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") > limit, "gen").otherwise("hw").alias("label"),
        F.when(F.col("ratio") >= limit, F.format_string("minified:>=%.1f", limit.cast("double"))).alias("reason"),
    )


def minified_path(path: str | Column) -> Column:
    """Whether the name of a file says that it is minified, in any case of letters."""
    return F.lower(F.col(path) if isinstance(path, str) else path).rlike(r"[.-]min\.js\z")


def has_extension(path: str | Column, language: str) -> Column:
    """Whether a path ends as the language's files do; upper case does not count."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for ending in EXTENSIONS[language]:
        out = out | p.endswith(ending)
    return out


def repository_id(text: Column) -> Column:
    """Struct (owner, name) of 'owner/name', null unless it has just that form."""
    valid = text.rlike(r"^[\w\-.]+/[\w\-.]+\z")
    return F.when(valid, F.struct(F.split(text, "/")[0].alias("owner"), F.split(text, "/")[1].alias("name")))


def clean_path(path: Column) -> Column:
    """A path without its first component, the archive's own folder."""
    return F.regexp_replace(path, r"^[^/]*/", "")


def safe_path(path: Column) -> Column:
    """Whether a path stays inside the folder it is joined to."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.contains("\\")


# writing


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` to append: one per key, and none whose key is there already."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with one row per key: a new one where there is any, whatever its ``order``; of several
    in one table the one with the largest ``order``, nulls last."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(order).desc_nulls_last())
    return both.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k", "_new")


def failure_reasons(failure: DataFrame) -> DataFrame:
    """hash, reason with the default where none is stored; the least of several."""
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit(DEFAULT_REASON))
    return failure.select("hash", reason.alias("reason")).groupBy("hash").agg(F.min("reason").alias("reason"))


def missing_references(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``child`` that ``parent`` lacks."""
    return child.select(*keys).distinct().join(parent.select(*keys).distinct(), keys, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """``child`` without the rows of deleted parents."""
    return child.join(deleted.select(*keys).distinct(), keys, "left_anti")


def grouped_median_of(values: list[int]) -> float:
    """The driver's version of ``grouped_median``, for tests and small reports."""
    ordered = sorted(values)
    m = ordered[len(ordered) // 2]
    return m - 0.5 + (len(ordered) / 2 - sum(v < m for v in ordered)) / sum(v == m for v in ordered)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; a value that is not a number raises an error. Null stays null."""
    if math.isnan(low) or math.isnan(high) or low > high:
        raise ValueError("bounds")
    value = x.cast("double")
    return F.when(F.isnan(value), F.raise_error(F.lit("not a number")).cast("double")).when(value <= low, F.lit(float(low))).when(value >= high, F.lit(float(high))).otherwise(value)


def at_least(x: Column, bound: float) -> Column:
    return F.greatest(x, F.lit(bound))


def at_most(x: Column, bound: float) -> Column:
    return F.least(x, F.lit(bound))
