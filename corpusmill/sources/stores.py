"""A corpus on disk: its folders, views over them, and writers of everything the operators make.

Writers append or replace whole Parquet tables in a folder that all executors share. Keyed rows that
are there already are not written twice, so a job may run again.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.corpus import insert_missing, safe_path
from corpusmill.sources.tables import SCHEMAS

#: Further tables, as DDL.
MORE = {
    "vector": "hash string, vector binary",
    "mistake": "source_file_id bigint, before_id bigint, before binary, after binary",
    "distance": "source_file_id bigint, before_id bigint, levenshtein int",
    "edit": "source_file_id bigint, before_id bigint, line_no int, fix string, fix_index int, mistake string, mistake_index int, old_token string, new_token string",
}
CORPUS = ["meta", "repository", "source_file", "repository_source", "source_summary", "failure"]
ALL = SCHEMAS | MORE


@dataclass(frozen=True)
class Layout:
    """Where the tables and files of a language's corpus lie."""

    root: str
    language: str

    def table(self, name: str) -> str:
        if name not in ALL:
            raise KeyError(name)
        return f"{self.root}/{self.language}/{name}.parquet"

    def models(self, model_id: str = "") -> str:
        return f"{self.root}/{self.language}/models/{model_id}".rstrip("/")

    def hash_lists(self) -> str:
        return f"{self.root}/{self.language}/partitions"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _file_system(spark, path)
    return system.exists(hadoop)


def table(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    """A table, or an empty one with its schema where there is none yet."""
    path = layout.table(name)
    return spark.read.schema(ALL[name]).parquet(path) if exists(spark, path) else spark.createDataFrame([], ALL[name])


def create(spark: SparkSession, layout: Layout) -> None:
    """Makes the corpus tables that are not there, empty, and notes the language. ValueError for a corpus
    of another language."""
    for name in CORPUS:
        if not exists(spark, layout.table(name)):
            spark.createDataFrame([], ALL[name]).write.parquet(layout.table(name))
    known = table(spark, layout, "meta").where("key = 'language'").first()
    if known is None:
        set_metadata(spark, layout, language=layout.language)
    elif known["value"] != layout.language:
        raise ValueError(f"the corpus holds {known['value']}, not {layout.language}")


def set_metadata(spark: SparkSession, layout: Layout, **values: object) -> None:
    """Notes values as text under keys that have none yet; ValueError for a key with another one."""
    rows = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], ALL["meta"])
    clash = rows.alias("n").join(table(spark, layout, "meta").alias("o"), "key").where("NOT n.value <=> o.value").select("key").first()
    if clash:
        raise ValueError(f"{clash['key']} has another value")
    append(spark, layout, "meta", rows, ["key"])


def append(spark: SparkSession, layout: Layout, name: str, rows: DataFrame, keys: list[str]) -> None:
    """Adds the rows whose key is not there yet, one for each key, in the table's columns."""
    columns = [c.split()[0] for c in ALL[name].split(", ")]
    insert_missing(table(spark, layout, name).select(*keys), rows.select(*columns), keys).write.mode("append").parquet(layout.table(name))


def put_vectors(spark: SparkSession, layout: Layout, vectors: DataFrame) -> None:
    """Stores vectors (hash, vector array<int>), one byte a token; an error for an index above 255."""
    from corpusmill.operators.languages import to_bytes

    append(spark, layout, "vector", vectors.select("hash", to_bytes("vector").alias("vector")), ["hash"])


def vectors(spark: SparkSession, layout: Layout) -> DataFrame:
    """hash, vector of the stored vectors."""
    from corpusmill.operators.languages import from_bytes

    return table(spark, layout, "vector").select("hash", from_bytes("vector").alias("vector"))


def put_distances_and_edits(spark: SparkSession, layout: Layout, language: str = "java") -> None:
    """Works out and stores the token distances of the stored mistakes, and the edits of those one apart."""
    from corpusmill.operators import mistakes

    pairs = mistakes.lexed(table(spark, layout, "mistake"), language)
    append(spark, layout, "distance", mistakes.distances(pairs), mistakes.KEYS)
    append(spark, layout, "edit", mistakes.edits(pairs), mistakes.KEYS)


def register_views(spark: SparkSession, layout: Layout) -> None:
    """Temporary views: every table under its name, and eligible_source (tokens, no failure)."""
    for name in ALL:
        table(spark, layout, name).createOrReplaceTempView(name)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY VIEW eligible_source AS SELECT DISTINCT s.hash FROM source_summary s "
        "LEFT ANTI JOIN failure f ON f.hash = s.hash WHERE s.n_tokens > 0"
    )


def drop_views(spark: SparkSession) -> None:
    for name in [*ALL, "eligible_source"]:
        spark.catalog.dropTempView(name)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes source to path below ``root``, in the file system that its URI names, and returns path and
    size. Paths that would leave the root are not written. A file appears under its name when it is
    whole, so tasks may run again; on a cluster a bare local path is refused."""
    spark = files.sparkSession
    if "://" not in root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name the shared folder by a URI")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for frame in frames:
            rows = []
            for path, source in zip(frame["path"], frame["source"]):
                target = f"{base}/{path}"
                part = f"{target}.{uuid4().hex}.part"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(bytes(source or b""))
                system.move(part, target)
                rows.append((path, len(source or b"")))
            yield pd.DataFrame(rows, columns=["path", "size"])

    return files.select("path", "source").where(safe_path(F.col("path"))).mapInPandas(run, "path string, size bigint")


def export_mistakes(mistakes: DataFrame, root: str, extension: str = "java") -> DataFrame:
    """Writes each mistake to source_file_id/before_id/{before,after}.extension below ``root``."""
    folder = F.concat_ws("/", F.col("source_file_id").cast("string"), F.col("before_id").cast("string"))
    sides = F.array(*(F.struct(F.concat(folder, F.lit(f"/{side}.{extension}")).alias("path"), F.col(side).alias("source")) for side in ("before", "after")))
    return write_files(mistakes.select(F.inline(sides)), root)


def log_epoch(spark: SparkSession, path: str, epoch: int, **values: float) -> None:
    """Adds a line to a training log; the header comes first, columns in the order of the first call.
    Runs on the driver, a line an epoch."""
    system, hadoop = _file_system(spark, path)
    text = ""
    if system.exists(hadoop):
        text = "\n".join(r["value"] for r in spark.read.text(path).collect()) + "\n"
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if not text:
        writer.writerow(["epoch", *values])
    columns = next(csv.reader([text.split("\n")[0]])) if text else ["epoch", *values]
    writer.writerow([{"epoch": epoch, **values}.get(c, "") for c in columns])
    stream = system.create(hadoop, True)
    stream.write(bytearray((text + out.getvalue()).encode()))
    stream.close()


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """A training log as a table."""
    return spark.read.csv(path, header=True, inferSchema=True)
