import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for file in sorted(Path(DATA).iterdir()):
        c.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return c


def plain(value):
    import math

    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (str, bytes)):
        return str(value)
    if hasattr(value, "__float__"):
        return round(float(value), 6)
    return str(value)


def table(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, row)) for row in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(left, right):
        assert table(left) == table(right)

    return check
