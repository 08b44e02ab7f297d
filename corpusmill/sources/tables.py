"""Schemas and readers of the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the corpus tables, as DDL.
SCHEMAS: dict[str, str] = {
    "meta": "key string, value string",
    "repository": "owner string, name string, revision string, commit_date timestamp_ntz, license string",
    "source_file": "hash string, source binary",
    "repository_source": "owner string, name string, hash string, path string",
    "source_summary": "hash string, sloc int, n_tokens int",
    "failure": "hash string, reason string",
    "partition_set": "partition int, set_name string",
    "license_item": "license_id string, title string",
    "benchmark": "item_id bigint, text string, suite string, set_name string",
}


def read(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` under ``root``; with ``columns`` only those are read from the files."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_or_empty(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A corpus table, or an empty one with its declared schema when it does not exist yet."""
    path = f"{root}/{name}.parquet"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], SCHEMAS[name])


def owner_key(column: str | Column = "owner") -> Column:
    """Spellings of one owner differ in case and outer spaces only."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
