"""What the jobs need from the session: importable workers and a shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    return spark


#: Rows that are broadcast at most; counted before.
SMALL = 300_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run in
    this process, as in tests. Raises on a cluster without one, as no other folder is shared."""
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    atexit.register(_remove, context, context.getCheckpointDir())
    return context.getCheckpointDir()


def _remove(context, folder: str) -> None:
    """Removes this session's own folder among the checkpoints, if the session still lives."""
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # stopped before: nothing can be reached any more
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and drops its lineage; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(big: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """Join of ``big`` with ``few``, which is broadcast only where a count proves that it has at most
    ``most`` rows; beyond that both are shuffled. ``few`` should be cheap to count."""
    return big.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, on, how)


#: Bytes of input a core below which an input is dealt out before heavy work.
SPREAD = 8_000_000


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt to all cores by a column where the input is small, since a small file is often one row
    group and thus one task. The shuffle is bounded by SPREAD bytes a core; larger inputs, which have
    row groups for all cores, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, by) if 0 < size < cores * SPREAD else df
