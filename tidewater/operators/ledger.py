"""Profit and loss, ownership and budgets over trade logs and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .lookups import prefix_join


def log_pnl(trades: DataFrame) -> DataFrame:
    """``(bot_type, pl)``: sold value less average cost of what was sold, per log.

    0 unless something was bought and something sold. Logs without quantities have 0.
    """
    value = F.col("price") * F.col("qty")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    buy, sell = rules.is_buy(F.col("action")), rules.is_sell(F.col("action"))
    s = trades.groupBy("bot_type").agg(
        zero(F.when(buy, value)).alias("bv"), zero(F.when(sell, value)).alias("sv"), zero(F.when(buy, F.col("qty"))).alias("b"), zero(F.when(sell, F.col("qty"))).alias("s")
    )
    pl = F.when((F.col("b") > 0) & (F.col("s") > 0), F.col("sv") - F.try_divide("bv", "b") * F.col("s")).otherwise(0.0)
    return s.select("bot_type", pl.alias("pl"))


def bot_pnl(logs: DataFrame) -> DataFrame:
    """``(bot, realized_pl)`` from :func:`log_pnl`; where several logs belong to one bot, the last by name counts."""
    return logs.select(rules.log_bot(F.col("bot_type")).alias("bot"), "bot_type", "pl").groupBy("bot").agg(F.max_by("pl", "bot_type").alias("realized_pl"))


def realized_pnl(trades: DataFrame) -> DataFrame:
    """``(bot, realized_pl)`` of all trades."""
    return bot_pnl(log_pnl(trades))


def attribute(positions: DataFrame, owners=rules.REPORT_OWNERS) -> DataFrame:
    return positions.withColumn("owner", rules.owner(F.col("symbol"), F.col("asset_class"), owners))


def listed_owners(spark, owners=rules.BUDGET_OWNERS) -> DataFrame:
    """Fixed owner lists as a table ``(ticker, bot, ordinal)`` in list order."""
    return spark.createDataFrame([(t, b, i) for i, (b, t) in enumerate((b, t) for b, tickers in owners.items() for t in tickers)], "ticker string, bot string, ordinal int")


def attribute_listed(positions: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds ``owner`` from a list ``(ticker, bot, ordinal)`` of any length.

    Options go to the first entry of the wheel or the condor that their symbol begins with, else to the condor; shares to
    the first entry of another bot or the wheel that they equal, else to the trend follower; crypto to the grid. Each symbol is looked up once.
    """
    kinds = positions.select("symbol", "asset_class").distinct()
    options = kinds.where("asset_class = 'US_OPTION'")
    first = prefix_join(options, listed.where(F.col("bot").isin("wheel_bot", "condor_bot")), "symbol", "ticker").groupBy("symbol", "asset_class").agg(F.min_by("bot", "ordinal").alias("_owner"))
    shares = kinds.where("asset_class not in ('US_OPTION', 'CRYPTO')").join(listed.where("bot <> 'condor_bot'"), F.col("symbol") == F.col("ticker")).groupBy("symbol", "asset_class").agg(F.min_by("bot", "ordinal").alias("_owner"))
    rest = F.when(F.col("asset_class") == "CRYPTO", "crypto_grid").when(F.col("asset_class") == "US_OPTION", "condor_bot").otherwise("trend_bot")
    return positions.join(first.unionByName(shares), ["symbol", "asset_class"], "left").withColumn("owner", F.coalesce("_owner", rest)).select(*positions.columns, "owner")


def bots(spark, names=rules.REPORT_BOTS) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "bot string")


def unrealized_by_owner(positions: DataFrame, names=rules.REPORT_BOTS) -> DataFrame:
    """``(bot, unrealized_pl, allocation)`` of the reported bots, 0 where nothing is held."""
    held = attribute(positions).groupBy(F.col("owner").alias("bot")).agg(F.sum("unrealized_pl").alias("u"), F.sum("market_value").alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.broadcast(bots(positions.sparkSession, names)).join(held, "bot", "left").select("bot", zero("u").alias("unrealized_pl"), zero("a").alias("allocation"))


def bot_performance(trades: DataFrame, positions: DataFrame, names=rules.REPORT_BOTS) -> DataFrame:
    """``(bot, allocation, unrealized_pl, realized_pl, total_pl)``."""
    out = unrealized_by_owner(positions, names).join(realized_pnl(trades), "bot", "left").withColumn("realized_pl", F.coalesce("realized_pl", F.lit(0.0)))
    return out.select("bot", "allocation", "unrealized_pl", "realized_pl", (F.col("unrealized_pl") + F.col("realized_pl")).alias("total_pl"))


def allowed(budgets: DataFrame | None, bot: str, spark) -> DataFrame:
    """One row ``(allowed)``: whether the budget check ``budgets(bot, allowed)`` lets a bot enter; true where it does not know the bot."""
    if budgets is None:
        return spark.createDataFrame([(True,)], "allowed boolean")
    return budgets.where(F.col("bot") == bot).agg(F.coalesce(F.bool_and("allowed"), F.lit(True)).alias("allowed"))


def budget_check(config_bots: DataFrame, positions: DataFrame, account: DataFrame) -> DataFrame:
    """``(bot, allocation, used, allowed)``; the two crypto bots share what the grid owns."""
    used = attribute(positions, rules.BUDGET_OWNERS).groupBy(F.col("owner").alias("_owner")).agg(F.sum("market_value").alias("used"))
    pool = F.when(F.col("bot") == "moon_bag", "crypto_grid").otherwise(F.col("bot"))
    out = config_bots.withColumn("_owner", pool).join(used, "_owner", "left").withColumn("used", F.coalesce("used", F.lit(0.0)))
    out = out.crossJoin(F.broadcast(account.select("equity").limit(1)))
    return out.select("bot", "allocation", "used", rules.within_budget(F.col("equity"), F.col("allocation"), F.col("used")).alias("allowed"))
