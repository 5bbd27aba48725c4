"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, a laptop) is a temporary folder set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
    return sc.getCheckpointDir().rstrip("/")


#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 2000
#: Tables written in this thread (or context), until :func:`forget` removes them: jobs side by side do not see each other's.
_tables: contextvars.ContextVar[list[str]] = contextvars.ContextVar("tables")


def _written() -> list[str]:
    try:
        return _tables.get()
    except LookupError:
        _tables.set(held := [])
        return held


def new_table(spark: SparkSession, name: str = "tidewater") -> str:
    """The path of a table to be written to the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage and survives lost executors; nothing is kept on an executor.
    """
    path = new_table(df.sparkSession)
    append(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds the rows of ``df`` to the table at ``path``."""
    spark = df.sparkSession
    # rows of text are long: fewer of them are handed to Python workers at a time
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        if not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(batch, BATCH_ROWS)
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(batch, before)


def written() -> int:
    """How many tables this thread has written and not removed; what is written later can be told apart by it."""
    return len(_written())


def forget(spark: SparkSession, since: int = 0, but: str | None = None) -> None:
    """Removes the tables that this thread has written since :func:`written` gave ``since``, except ``but``; frames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    held = _written()
    gone = [p for p in held[since:] if p != but]
    held[since:] = [p for p in held[since:] if p == but]
    for name in gone:
        at = path(name)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_hot(rows: DataFrame, known: DataFrame, key: str, count: str, total: int, how: str = "inner", least: int = 100_000) -> DataFrame:
    """``rows`` joined with ``known``, a row a key, whose column ``count`` tells how many of ``rows`` have the key.

    Keys of more than ``least`` rows, and more than one row in 10,000, are broadcast: there are fewer than
    10,000 of them whatever the size of the tables. All other keys meet in a shuffle, no task of which is hot.
    """
    limit = max(least, total // 10_000)
    slim = known.drop(count)
    if total <= limit or (known.agg(F.max(count)).first()[0] or 0) <= limit:
        return rows.join(slim, key, how)
    hot = settle(known.where(F.col(count) > limit).drop(count))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(slim, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
