"""Scans of trade logs, bars, quotes and option chains.

Predicates are plain column expressions, so they reach the file scan.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(sources: Mapping[str, DataFrame], tag: str = "bot_type") -> DataFrame:
    """All sources by column name, each with its own name in ``tag``; missing columns are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def recent(df: DataFrame, now: Column, days: int, time: str = "time") -> DataFrame:
    """Rows of the last ``days`` days before ``now``."""
    return df.where(F.col(time) > now - F.make_interval(days=F.lit(days)))


def trade_scan(sources: Mapping[str, DataFrame], now: Column, days: int = 30) -> DataFrame:
    """Time-bounded scan over several logs, tagged by log."""
    return recent(tagged_union(sources), now, days)


def dated_scan(log: DataFrame, now: Column, days: int = 30, time: str = "time", unit: str = "day") -> DataFrame:
    """:func:`recent` rows of a log laid out by ``period``: only files of these days are read, however old the log is."""
    first = F.to_date(F.date_trunc(unit, now - F.make_interval(days=F.lit(days))))
    return recent(log.where(F.col("period") >= first), now, days, time).drop("period")


def first_series(df: DataFrame, epoch: str = "time", hours: int = -5) -> DataFrame:
    """Epoch seconds to timestamps, shifted by a fixed number of hours (as the export does, daylight time or not)."""
    return df.withColumn(epoch, F.timestamp_seconds(epoch) + F.make_interval(hours=F.lit(hours)))


def make_bars(ticks: DataFrame, width: str, symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str = "id") -> DataFrame:
    """OHLC bars of ``width`` ('15 minutes', '1 hour', '1 day') from ticks; ``tie`` orders ticks of one instant."""
    order = F.struct(ts, tie)
    out = ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close")


def history(bars: DataFrame, symbols: list[str] | None = None, start: Column | None = None, limit: int | None = None, take: str = "latest", eastern: bool = False) -> DataFrame:
    """Bars of some symbols from ``start`` on, at most ``limit`` a symbol, the latest or the earliest."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.where(F.col("ts") >= start)
    if limit is not None:
        order = F.col("ts").desc() if take == "latest" else F.col("ts").asc()
        bars = bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(order))).where(F.col("_n") <= limit).drop("_n")
    return bars.withColumn("ts", F.from_utc_timestamp("ts", "US/Eastern")) if eastern else bars


def latest_trade(ticks: DataFrame, symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str = "id") -> DataFrame:
    return ticks.groupBy(F.col(symbol).alias("symbol")).agg(F.max_by(price, F.struct(ts, tie)).alias("price"), F.max(ts).alias("ts"))


def latest_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by(F.struct("ts", "open", "high", "low", "close"), "ts").alias("b")).select("symbol", "b.*")


def finished(bars: DataFrame) -> DataFrame:
    """Without the last, unfinished bar of each symbol; only its time is gathered per symbol."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return bars.join(last, "symbol").where("ts < _last").drop("_last")


def latest_quote(quotes: DataFrame, side: str = "bid") -> DataFrame:
    """Latest bid (to sell at) or ask (to buy at) per symbol."""
    last = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid_price", "ask_price"), "ts").alias("q"))
    return last.select("symbol", F.col("q.bid_price" if side == "bid" else "q.ask_price").alias("price"))


def option_chain(contracts: DataFrame, today: Column, least_days: int = 25, most_days: int = 45, kind: str | None = None, underlying: str | None = None, status: str = "active") -> DataFrame:
    """Contracts of a status that expire between two numbers of days from today, both included."""
    out = contracts.where((F.col("status") == status) & F.col("expiration").between(F.date_add(today, least_days), F.date_add(today, most_days)))
    if kind:
        out = out.where(F.col("type") == kind)
    return out.where(F.col("underlying") == underlying) if underlying else out


def position_quantity(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """Held quantity per symbol, 0 where nothing is held; slashes in symbols do not count."""
    held = positions.groupBy(F.replace("symbol", F.lit("/"), F.lit("")).alias("_s")).agg(F.sum("qty").alias("qty"))
    out = symbols.withColumn("_s", F.replace("symbol", F.lit("/"), F.lit(""))).join(held, "_s", "left").drop("_s")
    return out.withColumn("qty", F.coalesce("qty", F.lit(0.0)))
