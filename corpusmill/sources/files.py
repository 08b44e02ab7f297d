"""Readers of vocabularies, hash lists, manifests, archives and recorded responses; writers of folders."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.corpus import safe_path

SPECIALS = 3


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """vind, entry of a vocabulary kept as a JSON array; indices begin behind the special entries."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("entries"))
    return whole.select(F.posexplode("entries").alias("pos", "entry")).select((F.col("pos") + SPECIALS).alias("vind"), "entry")


def vocabulary_tsv(spark: SparkSession, path: str) -> DataFrame:
    """vind, entry, repr of a vocabulary kept as tab-separated lines; quotes are ordinary characters."""
    return spark.read.csv(path, sep="\t", quote="", schema="vind int, entry string, repr string")


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """hash: the lines of a text file, without outer spaces and blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("hash")).where("hash <> ''")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Model manifests, one JSON object a file; layer lists become text."""
    df = spark.read.json(path, multiLine=True)
    return df.withColumn("hidden_layers", F.array_join(F.col("hidden_layers").cast("array<string>"), ",")) if "hidden_layers" in df.columns else df


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """path, source, hash of plain files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("source"), F.sha2("content", 256).alias("hash"))


def archive_sources(spark: SparkSession, path: str, extensions: tuple[str, ...], with_failures: bool = False) -> DataFrame:
    """archive, path, source, hash of the files in zip archives that end as given, without the
    archive's own folder. Paths that leave the folder are left out. ``with_failures`` adds error: a
    broken archive, or a member that cannot be read, is a row with its reason and no source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if not info.is_dir() and info.filename.endswith(extensions):
                                try:
                                    rows.append((name, info.filename, archive.read(info), None))
                                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error) as fault:
                                    rows.append((name, info.filename, None, str(fault)))
                except zipfile.BadZipFile as fault:
                    rows.append((name, None, None, str(fault)))
            yield pd.DataFrame(rows, columns=["archive", "path", "source", "error"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, source binary, error string")
    cleaned = found.withColumn("path", F.regexp_replace("path", r"^[^/]*/", "")).where(F.col("path").isNull() | safe_path(F.col("path"))).withColumn("hash", F.sha2("source", 256))
    return cleaned.select("archive", "path", "source", "hash", "error") if with_failures else cleaned.where("error IS NULL").select("archive", "path", "source", "hash")


def recorded_downloads(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """url, body, error of requested urls by recorded bodies (url, status, body): what a download gives,
    without a network. A status other than 200, or none, is an error."""
    met = requests.select("url").distinct().join(recorded.select("url", "status", "body"), "url", "left")
    good = F.col("status") == 200
    return met.select("url", F.when(good, F.col("body")).alias("body"), F.when(F.col("status").isNull(), "not recorded").when(~good, F.concat(F.lit("status "), F.col("status").cast("string"))).alias("error"))


_RESPONSE = "data struct<repository: struct<name: string, owner: struct<login: string>, licenseInfo: struct<name: string>, defaultBranchRef: struct<target: struct<sha1: string, committedDate: string>>>>"


def repository_responses(responses: DataFrame, column: str = "body") -> DataFrame:
    """owner, name, revision, commit_date, license of recorded metadata responses; no license is ''."""
    r = F.from_json(column, _RESPONSE)["data"]["repository"]
    return responses.select(
        r["owner"]["login"].alias("owner"), r["name"].alias("name"), r["defaultBranchRef"]["target"]["sha1"].alias("revision"),
        F.to_timestamp(r["defaultBranchRef"]["target"]["committedDate"]).alias("commit_date"), F.coalesce(r["licenseInfo"]["name"], F.lit("")).alias("license"),
    )


def most_starred(found: DataFrame, n: int) -> DataFrame:
    """The n repositories with most stars, as paging through a search by falling stars would give;
    equal ones go by name, and none is lost at the edge of a page."""
    return found.orderBy(F.col("stars").desc(), "name").limit(n)


def star_pages(found: DataFrame, size: int) -> Iterator[DataFrame]:
    """Pages of ``size`` repositories by falling stars, then by name, each found by the last key of the
    page before (a filter and a top-k, no global sort). Repositories without stars are left out."""
    rest = found.where("stars IS NOT NULL")
    after = None
    while True:
        page = rest if after is None else rest.where((F.col("stars") < after[0]) | ((F.col("stars") == after[0]) & (F.col("name") > after[1])))
        page = page.orderBy(F.col("stars").desc(), "name").limit(size)
        last = page.select("stars", "name").orderBy(F.col("stars"), F.col("name").desc()).first()
        if last is None:
            return
        yield page
        after = last["stars"], last["name"]


def file_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, before, after of two folders' files with equal paths."""
    return before.select("path", F.col("source").alias("before")).join(after.select("path", F.col("source").alias("after")), "path")


def write_hash_lists(split: DataFrame, path: str) -> None:
    """One folder of hash lists for each partition and set."""
    split.select("partition", "set_name", F.col("hash").alias("value")).write.partitionBy("partition", "set_name").mode("overwrite").text(path)


def export_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes owner/name/path below a shared folder and returns path and size of each file written (see
    ``stores.write_files``)."""
    from corpusmill.sources.stores import write_files

    return write_files(files.select(F.concat_ws("/", "owner", "name", "path").alias("path"), "source"), root)
