"""Signal tables over enriched bars. No orders are placed."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import rules
from .ledger import allowed


def regimes(bars: DataFrame, length: int = 200, n: int = 14) -> DataFrame:
    """Regime of every bar: ``(symbol, ts, price, sma200, adx, regime)``."""
    rows = ind.enrich(bars, ind.sma(length, into="sma200"), ind.adx(n))
    return rows.select("symbol", "ts", F.col("close").alias("price"), "sma200", "adx", rules.regime(F.col("adx"), F.col("close"), F.col("sma200")).alias("regime"))


def sector_moves(bars: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Last one-bar move of each fund; a fund with one bar has none and is not hot."""
    last = ind.latest(ind.enrich(bars, ind.returns()))
    return last.select(F.col("symbol").alias("sector"), F.col("move").alias("move_pct"), rules.is_hot(F.col("move"), threshold).alias("hot"))


def sector_targets(moves: DataFrame, members: Mapping = rules.SECTORS, base=rules.BASE_TARGETS) -> DataFrame:
    """Symbols of hot sectors and those that always count, each once."""
    spark = moves.sparkSession
    of = spark.createDataFrame([(k, list(v)) for k, v in members.items()], "sector string, tickers array<string>")
    hot = moves.where("hot").join(F.broadcast(of), "sector").select(F.explode("tickers").alias("symbol"))
    return hot.union(spark.createDataFrame([(s,) for s in base], "symbol string")).distinct()


def watch_list(*lists: DataFrame) -> DataFrame:
    """Symbols of all lists (core list, scouted targets, held shares), each once."""
    return functools.reduce(DataFrame.union, (x.select("symbol") for x in lists)).distinct()


def _passes(rows: DataFrame, every: bool, calendar: DataFrame | None) -> DataFrame:
    """The bars at which a strategy looks: the last of each symbol or all; a pass outside a session is skipped as a whole."""
    rows = rows if every else ind.latest(rows)
    return rows if calendar is None else while_open(rows, calendar)


def trend_signals(bars: DataFrame, positions: DataFrame, account: DataFrame, targets: DataFrame, market_regime: str = "UNKNOWN", budgets: DataFrame | None = None, every: bool = False, calendar: DataFrame | None = None) -> DataFrame:
    """Cross signals per symbol at its last bar, or at ``every`` bar, in sessions of ``calendar`` only, if it is given.

    Held symbols may exit; the others may enter if they are targets, the regime lets them and
    the bot's budget (in ``budgets(bot, allowed)``, if given) has room. Sizes are whole shares.
    """
    rows = ind.enrich(bars, ind.ema(9), ind.ema(21), ind.adx(), ind.crossings("ema9", "ema21"))
    rows = _passes(rows, every, calendar)
    held = positions.groupBy("symbol").agg(F.max_by(F.struct("side", "qty"), "qty").alias("_p"))
    listed = targets.select("symbol").distinct().withColumn("_t", F.lit(True))
    rows = rows.where(~F.col("symbol").isin(*rules.CRYPTO_EXCLUDED)).join(held, "symbol", "left").join(listed, "symbol", "left")
    rows = rows.crossJoin(F.broadcast(account.select("equity").limit(1))).crossJoin(F.broadcast(allowed(budgets, "trend_bot", bars.sparkSession)))
    may = rules.may_trade(F.lit(market_regime), F.col("adx")) & F.coalesce("_t", F.lit(False)) & F.col("allowed")
    size = rules.trend_shares(F.col("equity"), F.col("close"))
    rows = rows.withColumn("action", rules.trend_action(F.col("_p.side"), F.col("bull_cross"), F.col("bear_cross"), F.col("adx"), may))
    qty = F.when(F.col("action").isin("sell", "buy_cover"), F.abs("_p.qty")).when(F.col("action").isNotNull(), size.cast("double"))
    out = rows.select("symbol", "ts", F.col("close").alias("price"), "ema9", "ema21", "adx", "action", qty.alias("qty"))
    return out.withColumn("action", F.when(F.col("qty") > 0, F.col("action")))


def survivor_signals(bars: DataFrame, positions: DataFrame, account: DataFrame, scouted: DataFrame, budgets: DataFrame | None = None, every: bool = False, calendar: DataFrame | None = None) -> DataFrame:
    """Exits of held symbols and entries on oversold ones, in sessions only if a ``calendar`` is given: ``(symbol, ts, price, rsi, sma200, action, reason, qty)``."""
    rows = ind.enrich(bars, ind.rsi(), ind.sma(200))
    rows = _passes(rows, every, calendar)
    held = positions.groupBy("symbol").agg(F.max_by(F.struct("avg_entry_price", "qty"), "qty").alias("_p"))
    picks = scouted.select("symbol").distinct().withColumn("_s", F.lit(True))
    rows = rows.where(~F.col("symbol").isin(*rules.CRYPTO_EXCLUDED)).join(held, "symbol", "left").join(picks, "symbol", "left")
    rows = rows.crossJoin(F.broadcast(account.select("portfolio_value").limit(1))).crossJoin(F.broadcast(allowed(budgets, "survivor_bot", bars.sparkSession)))
    leave = F.when(F.col("_p").isNotNull(), rules.survivor_exit(F.col("rsi"), rules.gain(F.col("close"), F.col("_p.avg_entry_price"))))
    scout = F.coalesce("_s", F.lit(False))
    enter = F.col("_p").isNull() & F.col("allowed") & rules.survivor_entry(F.col("rsi"), F.col("close"), F.col("sma200"), scout)
    size = rules.survivor_shares(F.col("portfolio_value"), F.col("close"))
    action = F.when(leave.isNotNull(), "sell").when(enter & (size > 0), "buy")
    qty = F.when(action == "sell", F.col("_p.qty")).when(action == "buy", size.cast("double"))
    why = F.when(action == "sell", leave).when(action == "buy", F.when(scout, rules.SCOUT_PICK).otherwise(rules.CORE))
    return rows.select("symbol", "ts", F.col("close").alias("price"), "rsi", "sma200", action.alias("action"), why.alias("reason"), qty.alias("qty"))


def breakout_signals(bars: DataFrame, positions: DataFrame, account: DataFrame, every: bool = False) -> DataFrame:
    """Donchian entries of flat symbols, within buying power, and exits of held ones. Slashes in symbols do not count."""
    rows = ind.enrich(bars, ind.donchian())
    rows = rows if every else ind.latest(rows)
    plain = F.replace("symbol", F.lit("/"), F.lit(""))
    held = positions.groupBy(plain.alias("_k")).agg(F.sum("qty").alias("_q"))
    rows = rows.withColumn("_k", plain).join(held, "_k", "left").crossJoin(F.broadcast(account.select("equity", "buying_power").limit(1)))
    q, price = F.coalesce("_q", F.lit(0.0)), F.col("close")
    size = rules.breakout_quantity(F.col("equity"), price)
    action = rules.breakout_action(q, price, F.col("entry_high"), F.col("exit_low"))
    action = F.when((action == "buy_breakout") & (size * price > F.col("buying_power")), None).otherwise(action)
    qty = F.when(action == "buy_breakout", size).when(action == "sell_breakout", q)
    return rows.select("symbol", "ts", price.alias("price"), "entry_high", "exit_low", action.alias("action"), qty.alias("qty"), F.when(action == "buy_breakout", F.round(size, 4)).otherwise(qty).alias("order_qty"))


def while_open(rows: DataFrame, calendar: DataFrame, zone: str = "US/Eastern") -> DataFrame:
    """Rows whose ``ts`` (UTC) falls into a session of ``calendar(day date, opens string, closes string)``, HH:mm in ``zone``.

    A day that the calendar does not list has no session. The calendar holds a row a day and is broadcast.
    """
    local = F.from_utc_timestamp("ts", zone)
    days = F.broadcast(calendar.select(F.col("day").alias("_day"), F.col("opens").alias("_opens"), F.col("closes").alias("_closes")))
    at = F.date_format(local, "HH:mm")
    return rows.join(days, F.col("_day") == F.to_date(local)).where((at >= F.col("_opens")) & (at < F.col("_closes"))).select(*rows.columns)


def sizes(prices: DataFrame, account: DataFrame) -> DataFrame:
    """Order size of each strategy at a price."""
    rows = prices.crossJoin(F.broadcast(account.select("equity").limit(1)))
    e, p = F.col("equity"), F.col("price")
    return rows.select("symbol", "price", rules.trend_shares(e, p).alias("trend_qty"), rules.survivor_shares(e, p).alias("survivor_qty"), rules.breakout_quantity(e, p).alias("breakout_qty"), rules.grid_quantity(p).alias("grid_qty"))
