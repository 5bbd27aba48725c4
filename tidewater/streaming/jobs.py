"""Structured Streaming forms of the poll loops.

State lives in the engine's state store below the checkpoint, so a stream that is stopped, or whose
executors are lost, goes on where it was, and nothing is written that grows with the number of
batches: what a stream knows is read back from the store (:func:`grid_states`) or from the last
batch's table, of which one older copy is kept (:func:`latest_table`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import rules
from ..operators import ledger
from ..operators.grid import INVENTORY, fold_trades, zoned

#: Poll periods of the strategies, as processing-time triggers.
TRIGGERS = {"grid": "30 seconds", "trend": "60 seconds", "survivor": "60 seconds", "report": "300 seconds", "wheel": "900 seconds", "condor": "1800 seconds", "breakout": "3600 seconds"}


def polled(writer: DataStreamWriter, strategy: str, once: bool = False, every: str | None = None) -> DataStreamWriter:
    """Triggers a stream as often as ``strategy`` polls (or ``every`` so often), or takes what is there and ends."""
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every or TRIGGERS[strategy])


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLC bars of a stream ``(symbol, ts timestamp, id, price)``; ticks later than ``late`` are left out."""
    order = F.struct("ts", "id")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close")


_STATE = INVENTORY.replace("symbol string, ", "")


def stream_grid(ticks: DataFrame, bottom: float, top: float, levels: int, budget: float = 50.0) -> DataFrame:
    """The grid of each symbol of a stream ``(symbol, ts, id, price)`` as keyed state; a row a symbol and micro-batch, after it.

    Ticks of one batch are taken in order of ``(ts, id)``, batches one after the other. Of a batch's ticks of a
    symbol a task holds time, id, zone and size, 32 bytes each, so triggers bound what it needs; only changes of zone
    are folded.
    """
    rows = zoned(ticks, bottom, top, levels).withColumn("qty", rules.grid_quantity(F.col("price"), budget))
    rows = rows.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), "zone", "qty")

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        zone, held, buys, sells, blocked = state.get if state.exists else (-1, 0.0, 0, 0, 0)
        at, tick, zones, sizes = (np.concatenate(c) for c in zip(*([p[c].to_numpy() for c in ("at", "id", "zone", "qty")] for p in parts)))
        order = np.lexsort((tick, at))
        zones, sizes = zones[order], sizes[order]
        before = np.concatenate([[zone], zones[:-1]])
        moved = np.flatnonzero((zones != before) & (before != -1))
        actions = np.where(zones[moved] < before[moved], "grid_buy", "grid_sell").tolist()
        for done, held in fold_trades(zip(actions, sizes[moved].tolist()), held):
            buys, sells, blocked = buys + (done == "grid_buy"), sells + (done == "grid_sell"), blocked + (done == "blocked")
        now = (int(zones[-1]), float(held), int(buys), int(sells), int(blocked))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["symbol", "zone", "held", "buys", "sells", "blocked"])

    return rows.groupBy("symbol").applyInPandasWithState(advance, INVENTORY, _STATE, "update", GroupStateTimeout.NoTimeout)


def grid_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What :func:`stream_grid` knows of each symbol, from the state store below its checkpoint."""
    stored = spark.read.format("statestore").load(checkpoint)
    state = F.col("value.groupState")
    return stored.select(F.col("key.symbol").alias("symbol"), *(state[c].alias(c) for c in ("zone", "held", "buys", "sells", "blocked")))


def running_pnl(trades: DataFrame) -> DataFrame:
    """Realized profit of a stream of tagged trade logs: sums by log as state, the profit a projection of them; for the output mode ``complete``."""
    return ledger.log_pnl(trades)


def latest_table(writer: DataStreamWriter, folder: str) -> DataStreamWriter:
    """Keeps the result of the last batch at ``folder/n=<batch>``, and the one before for those who read it just now."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/n={n}")
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("n=") and int(name[2:]) < n - 1:
                files.delete(status.getPath(), True)

    return writer.foreachBatch(keep)


def read_latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last batch's table of :func:`latest_table`; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # a batch's folder counts once its writer has committed
    done = [int(s.getPath().getName()[2:]) for s in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if files.exists(path) else []
    return spark.read.schema(schema).parquet(f"{folder}/n={max(done)}") if done else spark.createDataFrame([], schema)
