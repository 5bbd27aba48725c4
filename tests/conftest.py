import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


def plain(value):
    """A value in a form in which both engines agree."""
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, float):
        return float(value)
    return int(value) if hasattr(value, "__int__") and not isinstance(value, bool | str) else str(value)


def whole(column):
    """Integers with nulls, which one engine gives as floats and the other as nullable integers, as the latter."""
    held = column.dropna()
    return column.astype("Int64") if column.dtype == float and column.isna().any() and len(held) and (held == held.round()).all() else column


def rows_of(frame):
    frame = frame[sorted(frame)].apply(whole)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.astype(object).itertuples(index=False))
