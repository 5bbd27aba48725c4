"""Streams that stop and go on, against the batch operators on all rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import grid, ledger
from tidewater.streaming import jobs

GRID = dict(bottom=10.0, top=85.0, levels=6)
TICKS = "symbol string, ts timestamp, id long, price double"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def ticks(spark, tmp_path):
    """Eight files of ticks, each later than the one before, in no order inside; a third of all rows of one symbol."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", "c", "d", "e"]), T0 + dt.timedelta(seconds=i // 2), i, rng.choice([0.0, None, *[rng.uniform(5, 95)] * 8])) for i in range(1600)]
    files = []
    for k in range(8):
        part = rows[k * 200 : (k + 1) * 200]
        rng.shuffle(part)
        spark.createDataFrame(part, TICKS).coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
        name = next(f for f in os.listdir(f"{tmp_path}/all/{k}") if f.startswith("part-"))
        files.append(f"{tmp_path}/all/{k}/{name}")
    os.makedirs(f"{tmp_path}/in")
    return spark.createDataFrame(rows, TICKS), files


def arrive(files, folder):
    for f in files:
        os.link(f, f"{folder}/{os.path.basename(f)}")


def once(writer, state):
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def test_grid_goes_on_from_its_checkpoint(spark, ticks, tmp_path):
    rows, files = ticks
    state = f"{tmp_path}/state"
    keep = "spark.sql.streaming.minBatchesToRetain"
    before = spark.conf.get(keep)
    spark.conf.set(keep, 2)
    try:
        for at in (0, 3, 5):
            arrive(files[at : {0: 3, 3: 5, 5: 8}[at]], f"{tmp_path}/in")
            # a new query each time, as after a crash
            stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            once(jobs.stream_grid(stream, **GRID).writeStream.outputMode("update").format("noop"), state)
            seen = rows.where(F.col("id") < {0: 600, 3: 1000, 5: 1600}[at])
            want = {r["symbol"]: r for r in grid.grid_inventory(seen, **GRID).collect()}
            got = {r["symbol"]: r for r in jobs.grid_states(spark, state).collect()}
            assert set(got) == set(want)
            for s, r in want.items():
                assert (got[s]["zone"], got[s]["buys"], got[s]["sells"], got[s]["blocked"]) == (r["zone"], r["buys"], r["sells"], r["blocked"])
                assert got[s]["held"] == pytest.approx(r["held"])
        # the logs of the checkpoint keep a fixed number of batches
        assert len([f for f in os.listdir(f"{state}/offsets") if not f.startswith(".")]) <= 4
    finally:
        spark.conf.set(keep, before)


def test_running_profit(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["trades", "crypto_trades", "survivor_trades"]), rng.choice(["buy", "Grid_SELL", "sell", "startup", None]), rng.uniform(1, 9), rng.choice([None, 1.0, 2.5])) for _ in range(300)]
    schema = "bot_type string, action string, price double, qty double"
    os.makedirs(f"{tmp_path}/in")
    for n, end in enumerate((100, 150, 300)):
        spark.createDataFrame(rows[(0, 100, 150)[n] : end], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        once(jobs.latest_table(jobs.running_pnl(stream).writeStream.outputMode("complete"), f"{tmp_path}/out"), f"{tmp_path}/state")
        want = {r["bot"]: r["realized_pl"] for r in ledger.realized_pnl(spark.createDataFrame(rows[:end], schema)).collect()}
        got = {r["bot"]: r["realized_pl"] for r in ledger.bot_pnl(jobs.read_latest(spark, f"{tmp_path}/out", "bot_type string, pl double")).collect()}
        assert got == pytest.approx(want)
    assert sorted(f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")) == ["n=1", "n=2"]
    assert jobs.read_latest(spark, f"{tmp_path}/none", "pl double").count() == 0


def test_polled_every(spark):
    class Writer:
        def trigger(self, **how):
            return how

    assert jobs.polled(Writer(), "report", every="1 second") == {"processingTime": "1 second"}
