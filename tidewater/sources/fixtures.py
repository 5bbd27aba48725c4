"""The library's inputs as views of the test tables.

Prices are the values of events, symbols their types; trade logs come from order lines,
positions from customers, option contracts from parts. Small dimensions are literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scans

#: Logs by line number mod 7.
LOGS = {1: "trades", 2: "crypto_trades", 3: "survivor_trades", 4: "wheel_trades", 5: "condor_trades"}
HELD = ("TQQQ", "SPXL", "DIS", "F", "NVDA", "BTCUSD", "F240119P00010000", "FNGU240119C00200000", "TSLA240119P00200000", "PLTR")
SPOT = 950.0
GRID = {"bottom": 10.0, "top": 85.0, "levels": 6}
ACCOUNT = (100_000.0, 50_000.0, 20_000.0, 100_000.0)
#: (symbol, side, qty, entry) of the positions in event symbols.
EVENT_POSITIONS = (("click", "long", 10.0, 40.0), ("view", "short", -5.0, 60.0))
#: A sample of this library's own: bots that the playbook and the owners know, and one of no strategy.
CONFIG = """{"bots": {"crypto_grid": {"status": "active", "allocation": 0.2},
"survivor_bot": {"status": "active", "allocation": 0.5},
"wheel_bot": {"status": "paused", "strategy": "puts on dips"},
"trend_bot": {"status": "active", "allocation": 9000.0},
"moon_bag": {"status": "paused", "allocation": 4000.0},
"condor_bot": {"status": "active", "allocation": 0.0},
"event_watch": {"script": "jobs/events", "status": "active", "strategy": "report bursts of clicks"}},
"global_settings": {"market_condition": "calm"}}"""
#: The grid is listed twice: its last state counts.
PROCESS_LIST = """[{"name": "crypto_grid", "pm2_env": {"status": "stopped", "restart_time": 1}},
{"name": "crypto_grid", "pm2_env": {"status": "online", "memory": 1000, "cpu": 1.5, "restart_time": 2, "pm_uptime": 1700000000000}},
{"name": "survivor_bot", "pm2_env": {"status": "stopped", "memory": 10, "cpu": 0.0, "restart_time": 7, "pm_uptime": 1700000000000}},
{"name": "wheel_bot", "pm2_env": {"status": "online", "restart_time": 0, "pm_uptime": 1700000500000}},
{"name": "condor_bot", "pm2_env": {"status": "errored"}},
{"name": "supervisor", "pm2_env": {"status": "online", "memory": 5, "cpu": 0.5, "restart_time": 1, "pm_uptime": 1700000900000}}]"""
#: Days of January 2024 without a session, besides weekends.
HOLIDAYS = ("2024-01-01", "2024-01-15")
NOW_MS = 1_700_001_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    return scans.make_bars(ticks(spark, sf_dir), width)


def logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One trade log each; options logs have no quantity."""
    return split_logs(table(spark, sf_dir, "lineitem"))


def split_logs(line: DataFrame) -> dict[str, DataFrame]:
    """The logs that a table, or a stream, of order lines stands for."""
    action = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "N", "Grid_SELL").otherwise("startup")
    base = [F.col("l_shipdate").alias("time"), F.concat(F.lit("SYM"), (F.col("l_suppkey") % 10).cast("string")).alias("symbol"), action.alias("action"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")]
    out = {}
    for k in (1, 2, 3, 4, 5, 0):
        kind = F.col("l_linenumber") % 7
        rows = line.where(kind == k if k else ~kind.isin(*LOGS))
        out[LOGS.get(k, "breakout_trades")] = rows.select(*base, *([] if k in (4, 5) else [F.col("l_quantity").alias("qty")]))
    return out


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    held = F.element_at(F.array(*map(F.lit, HELD)), (k % 10 + 1).cast("int"))
    kind = F.when(k % 10 == 5, "CRYPTO").when((k % 10).between(6, 8), "US_OPTION").otherwise("US_EQUITY")
    qty = (k % 21 - 10).cast("double")
    return table(spark, sf_dir, "customer").select(
        held.alias("symbol"), kind.alias("asset_class"), F.when(qty < 0, "short").otherwise("long").alias("side"), qty.alias("qty"), (k % 50).cast("double").alias("avg_entry_price"),
        (k % 37 + 1).cast("double").alias("current_price"), F.col("c_acctbal").alias("market_value"), (F.col("c_acctbal") * 0.1).alias("unrealized_pl"), k.alias("ordinal"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "part").select(
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_brand").alias("underlying"), F.when(F.col("p_partkey") % 2 == 0, "PUT").otherwise("CALL").alias("type"),
        F.date_add(today, F.col("p_size").cast("int")).alias("expiration"), F.round((F.col("p_retailprice") - 900.0) * 9 + 500.0, 2).alias("strike"), F.lit("active").alias("status"),
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).select("underlying").distinct().withColumn("spot", F.lit(SPOT))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = contracts(spark, sf_dir), F.regexp_extract("symbol", "([0-9]+)$", 1).cast("bigint")
    return c.select("symbol", F.lit("2024-01-01").cast("timestamp").alias("ts"), ((k % 40) / 100.0).alias("bid_price"), ((k % 40) / 100.0 + 0.05).alias("ask_price"))


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of held options, one a position, later ones from higher customers; some asks are 0."""
    rows = positions(spark, sf_dir).where("asset_class = 'US_OPTION'")
    ask = (F.col("ordinal") % 4) / 10.0
    return rows.select("symbol", F.timestamp_seconds("ordinal").alias("ts"), F.greatest(ask - 0.05, F.lit(0.0)).alias("bid_price"), ask.alias("ask_price"))


def calendar(spark: SparkSession) -> DataFrame:
    """Sessions of the stock market in January 2024."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day"))
    return days.where((F.weekday("day") < 5) & ~F.col("day").cast("string").isin(*HOLIDAYS)).select("day", F.lit("09:30").alias("opens"), F.lit("16:00").alias("closes"))


def account(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([ACCOUNT], "equity double, cash double, buying_power double, portfolio_value double")


def event_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_POSITIONS, "symbol string, side string, qty double, avg_entry_price double")


def symbols(spark: SparkSession, names=("purchase", "signup", "error", "click", "view")) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def texts(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string")

