"""Registered streaming queries over the given tables, replayed from files by micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import ledger
from ..sources import fixtures, scans, sinks
from ..streaming import jobs
from . import ledger as batch
from . import market
from .ledger import REPORT_LOGS


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet")


def _ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"))


def replay(spark, sf_dir: str):
    """Events as a stream of files."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _ticks(spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir))


def _finish(writer, strategy: str):
    """Runs a stream over what is there; the query, at its end."""
    query = jobs.polled(writer, strategy, once=True).start()
    query.awaitTermination()
    return query


def stream_grid(spark, sf_dir):
    state = f"{sinks.work_folder(spark, 'stream')}/state"
    grid = jobs.stream_grid(replay(spark, sf_dir).where("symbol = 'click'"), **fixtures.GRID)
    _finish(grid.writeStream.outputMode("update").format("noop").option("checkpointLocation", state), "grid")
    return jobs.grid_states(spark, state).withColumn("held", F.round("held", 4))


def _kept_bars(bars: DataFrame, top: str):
    """A writer of changed bars, a folder a batch."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/n={n}")

    return bars.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{top}/state")


def _last_bars(spark, top: str) -> DataFrame:
    """Of a bar's states the last batch's."""
    out = spark.read.schema(f"{schemas.BARS.replace('timestamp_ntz', 'timestamp')}, n bigint").parquet(f"{top}/out")
    last = out.groupBy("symbol", "ts").agg(F.max_by(F.struct("open", "high", "low", "close"), "n").alias("s"))
    return last.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "s.*")


def stream_bars(spark, sf_dir):
    top = sinks.work_folder(spark, "stream")
    query = _finish(_kept_bars(jobs.stream_bars(replay(spark, sf_dir)), top), "report")
    return _last_bars(spark, top) if query.lastProgress else spark.createDataFrame([], schemas.BARS)


#: The days at which the replay's files are cut.
CUTS = ("2024-01-08", "2024-01-15", "2024-01-22")


def is_late(events: DataFrame) -> Column:
    """Rows of the first file that arrive with the last one only."""
    return (events["ts"] < F.lit(CUTS[0]).cast("timestamp_ntz")) & (events["event_id"] % 97 == 0)


def stream_live(spark, sf_dir, every: str = "1 second"):
    """Hourly bars of files that arrive while the stream runs on its processing-time trigger; what comes weeks late falls to the watermark."""
    top = sinks.work_folder(spark, "stream")
    events = fixtures.table(spark, sf_dir, "events")
    part = F.when(is_late(events), len(CUTS)).otherwise(sum((F.col("ts") >= F.lit(c).cast("timestamp_ntz")).cast("int") for c in CUTS))
    events.withColumn("part", part).write.partitionBy("part").parquet(f"{top}/staged")
    parts = [r["part"] for r in spark.read.parquet(f"{top}/staged").select("part").distinct().orderBy("part").collect()]
    arrived = f"{top}/in"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(arrived))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(arrived)
    query = jobs.polled(_kept_bars(jobs.stream_bars(_ticks(stream)), top), "report", every=every).start()
    try:
        for p in parts:
            # a rename, so that the stream never sees half of a file
            files.rename(path(f"{top}/staged/part={p}"), path(f"{arrived}/part={p}"))
            query.processAllAvailable()
    finally:
        query.stop()
    return _last_bars(spark, top) if parts else spark.createDataFrame([], schemas.BARS)


def stream_pnl(spark, sf_dir):
    """Realized profit as the report polls it: sums by log as state, updated by every micro-batch of trades."""
    top = sinks.work_folder(spark, "stream")
    logs = fixtures.split_logs(_stream(spark, sf_dir, "lineitem"))
    trades = scans.tagged_union({n: logs[n] for n in REPORT_LOGS})
    writer = jobs.latest_table(jobs.running_pnl(trades).writeStream.outputMode("complete"), f"{top}/out")
    _finish(writer.option("checkpointLocation", f"{top}/state"), "report")
    return ledger.bot_pnl(jobs.read_latest(spark, f"{top}/out", "bot_type string, pl double")).withColumn("realized_pl", F.round("realized_pl", 4))


QUERIES = {"stream_grid": stream_grid, "stream_bars": stream_bars, "stream_live": stream_live, "stream_pnl": stream_pnl}


_LIVE = market.bars_sql("1 hour").replace("FROM events", f"FROM (SELECT * FROM events WHERE NOT (ts < TIMESTAMP '{CUTS[0]}' AND event_id % 97 = 0)) AS events")

#: The batch queries' SQL; the live bars are those without the late rows.
SQL = {"stream_grid": market.SQL["grid_inventory"], "stream_bars": market.SQL["bars_hourly"], "stream_live": f"WITH {_LIVE} SELECT * FROM bars", "stream_pnl": batch.SQL["realized_pnl"]}
