"""Ownership, regime, entry, exit and sizing rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tickers of each strategy, as budgets see them ...
BUDGET_OWNERS = {
    "survivor_bot": ("TQQQ", "SQQQ", "SOXL", "SOXS", "FNGU", "UPRO", "SPXL", "SPXS"),
    "wheel_bot": ("DIS", "F", "PLTR"),
    "condor_bot": ("COIN", "MSTR", "TSLA", "NVDA", "NFLX"),
}
#: ... and as the profit report does.
REPORT_OWNERS = {**BUDGET_OWNERS, "survivor_bot": ("TQQQ", "SQQQ", "SOXL", "SOXS", "FNGU", "UPRO")}
#: Bots of the profit report, and bots of trade logs (others: trend_bot).
REPORT_BOTS = ("crypto_grid", "trend_bot", "survivor_bot", "wheel_bot", "condor_bot")
LOG_BOTS = {"crypto_trades": "crypto_grid", "survivor_trades": "survivor_bot", "wheel_trades": "wheel_bot", "condor_trades": "condor_bot"}
#: Desired status of each bot in each regime.
PLAYBOOK = {
    "BULL_TREND": {"trend_bot": "active", "survivor_bot": "active", "moon_bag": "active", "crypto_grid": "paused", "wheel_bot": "active"},
    "BEAR_TREND": {"trend_bot": "active", "survivor_bot": "paused", "moon_bag": "paused", "crypto_grid": "paused", "wheel_bot": "paused"},
    "CHOP": {"trend_bot": "paused", "survivor_bot": "paused", "moon_bag": "active", "crypto_grid": "active", "wheel_bot": "active"},
}
#: Stocks that a sector fund's move activates, and those that always are.
SECTORS = {
    "XLK": ("NVDA", "AMD", "MSFT", "PLTR"),
    "XLE": ("XOM", "CVX", "OXY"),
    "XLF": ("JPM", "BAC", "GS"),
    "XLV": ("LLY", "UNH", "PFE"),
    "GLD": ("GLD", "NEM", "GOLD"),
    "SLV": ("SLV", "AG", "PAAS"),
    "BITO": ("BITI", "MSTR", "COIN", "MARA", "CLSK"),
    "XBI": ("LABU", "XBI"),
    "SMH": ("SOXL", "NVDA", "TSM"),
}
BASE_TARGETS = ("SPY", "QQQ", "IWM")
CRYPTO_EXCLUDED = ("BTC/USD", "ETH/USD")


def owner(symbol: Column, asset_class: Column, owners: Mapping[str, Sequence[str]] = BUDGET_OWNERS) -> Column:
    """The strategy a position belongs to. Options go by the first ticker, in list order, that their symbol begins with."""
    option = F.lit(None).cast("string")
    chain = None
    for bot in ("wheel_bot", "condor_bot"):
        for ticker in owners[bot]:
            hit = symbol.startswith(ticker)
            chain = F.when(hit, bot) if chain is None else chain.when(hit, bot)
    option = chain.otherwise("condor_bot")
    return (
        F.when(asset_class == "CRYPTO", "crypto_grid")
        .when(asset_class == "US_OPTION", option)
        .when(symbol.isin(*owners["survivor_bot"]), "survivor_bot")
        .when(symbol.isin(*owners["wheel_bot"]), "wheel_bot")
        .otherwise("trend_bot")
    )


def log_bot(log: Column) -> Column:
    out = F.lit("trend_bot")
    for name, bot in LOG_BOTS.items():
        out = F.when(log == name, bot).otherwise(out)
    return out


def within_budget(equity: Column, allocation: Column, used: Column) -> Column:
    """True without an allocation, else whether money is left."""
    return F.when(F.coalesce(allocation, F.lit(0.0)) == 0, True).otherwise(equity * allocation - used > 0)


def is_buy(action: Column) -> Column:
    return F.lower(action).contains("buy")


def is_sell(action: Column) -> Column:
    return F.lower(action).contains("sell")


def regime(adx: Column, price: Column, sma: Column, strong: float = 25.0) -> Column:
    return F.when((adx > strong) & (price > sma), "BULL_TREND").when(adx > strong, "BEAR_TREND").otherwise("CHOP")


def may_trade(market_regime: Column, local_adx: Column, override: float = 30.0) -> Column:
    """In a choppy market only what trends by itself may be traded."""
    return F.when(market_regime.contains("CHOP"), F.coalesce(local_adx > override, F.lit(False))).otherwise(True)


def trend_action(side: Column, bull: Column, bear: Column, local_adx: Column, allowed: Column, strong: float = 20.0) -> Column:
    """Exit on a cross against the position; entry on a cross in a trend where nothing is held."""
    entry = side.isNull() & allowed & (local_adx > strong)
    return F.when((side == "long") & bear, "sell").when((side == "short") & bull, "buy_cover").when(entry & bull, "buy").when(entry & bear, "sell_short")


#: The texts of reasons to sell, in order, the first with the rounded RSI in it, and to buy.
OVERBOUGHT, TAKE_PROFIT, STOP_LOSS = ("RSI Overbought (", ")"), "Take Profit (+5%)", "Stop Loss (-3%)"
SCOUT_PICK, CORE = "SCOUT PICK", "CORE"


def survivor_exit(rsi: Column, gain: Column, high: float = 70.0, win: float = 0.05, loss: float = -0.03) -> Column:
    """Reason to sell, the first that holds; null if none."""
    return F.when(rsi > high, F.concat(F.lit(OVERBOUGHT[0]), F.bround(rsi, 0).cast("int").cast("string"), F.lit(OVERBOUGHT[1]))).when(gain > win, TAKE_PROFIT).when(gain < loss, STOP_LOSS)


def survivor_entry(rsi: Column, price: Column, sma: Column, scouted: Column, low: float = 30.0) -> Column:
    return (rsi < low) & ((price > F.coalesce(sma, F.lit(0.0))) | scouted)


def breakout_action(held: Column, price: Column, entry_high: Column, exit_low: Column) -> Column:
    return F.when((held == 0) & (price > entry_high), "buy_breakout").when((held > 0) & (price < exit_low), "sell_breakout")


def is_hot(move: Column, threshold: float = 0.02) -> Column:
    return F.coalesce(F.abs(move) >= threshold, F.lit(False))


def grid_zone(price: Column, bottom: float, top: float, levels: int) -> Column:
    """-1 below the range, ``levels`` above it, else the zone from 0; the top itself is zone ``levels``."""
    size = (top - bottom) / levels
    return F.when(price < bottom, -1).when(price > top, levels).otherwise(((price - bottom) / size).cast("int"))


def whole_shares(budget: Column, price: Column) -> Column:
    """Shares that a budget buys, cut to a whole number."""
    return F.try_divide(budget, price).cast("bigint")


def trend_shares(equity: Column, price: Column, risk: float = 0.02, stop: float = 0.02) -> Column:
    return F.try_divide(equity * risk, price * stop).cast("bigint")


def survivor_shares(equity: Column, price: Column, risk: float = 0.05) -> Column:
    return whole_shares(equity * risk, price)


def breakout_quantity(equity: Column, price: Column, share: float = 0.1) -> Column:
    return F.try_divide(equity * share, price)


def grid_quantity(price: Column, budget: float = 50.0) -> Column:
    return F.try_divide(F.lit(budget), price)


def capture(entry: Column, current: Column) -> Column:
    """Share of a sold premium that is kept; null unless the entry is positive."""
    return F.when(entry > 0, F.try_divide(entry - current, entry))


def gain(price: Column, entry: Column) -> Column:
    return F.try_divide(price - entry, entry)


def option_root(symbol: Column) -> Column:
    """What precedes the first digit; all of it if there is none."""
    return F.regexp_extract(symbol, r"^([^0-9]*)", 1)


def market_hours(ts: Column, first: int = 8, last: int = 17) -> Column:
    return F.hour(ts).between(first, last)


def leg_limit(side: Column, bid: Column, ask: Column, least: float = 0.01, instead: float = 0.05) -> Column:
    quote = F.when(side == "BUY", ask).otherwise(bid)
    return F.when(quote <= least, instead).otherwise(quote)


def close_limit(ask: Column, current: Column, bump: float = 1.05) -> Column:
    """The ask, or the estimate and a bit where there is none."""
    return F.when(ask == 0, current * bump).otherwise(ask)


def wheel_side(stock_qty: Column) -> Column:
    return F.when(stock_qty >= 100, "CALL").otherwise("PUT")
