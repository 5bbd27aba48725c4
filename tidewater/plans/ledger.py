"""Registered queries over trade logs, positions, option contracts and process states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import rules
from ..operators import fleet, ledger, options, signals
from ..sources import documents, fixtures, scans, sinks

#: Logs that the profit report reads, and those that the export does.
REPORT_LOGS = ("trades", "crypto_trades", "survivor_trades", "wheel_trades", "condor_trades")
EXPORT_LOGS = ("trades", "crypto_trades", "survivor_trades", "breakout_trades", "wheel_trades")
NOW = "2001-06-30"


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


def _logs(s, d, names):
    found = fixtures.logs(s, d)
    return {n: found[n] for n in names}


def trades_union(s, d):
    return sinks.known_first(scans.tagged_union(fixtures.logs(s, d)))


def trade_scan(s, d):
    return scans.trade_scan(_logs(s, d, REPORT_LOGS), F.lit(NOW).cast("timestamp"), 30)


def trade_export(s, d):
    """Newest first, ties by the other columns."""
    rows = scans.recent(scans.tagged_union(_logs(s, d, EXPORT_LOGS)), F.lit(NOW).cast("timestamp"), 7)
    rows = rows.withColumn("time", F.col("time") - F.expr("INTERVAL 5 HOURS"))
    return sinks.known_first(rows).orderBy(F.desc("time"), "symbol", "action", "price")


def epoch_times(s, d):
    rows = fixtures.ticks(s, d).select("id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"))
    return scans.first_series(rows).select("id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("local"))


def realized_pnl(s, d):
    return _r(ledger.realized_pnl(scans.tagged_union(_logs(s, d, REPORT_LOGS))), "realized_pl")


def owner_attribution(s, d):
    p = fixtures.positions(s, d).select("symbol", "asset_class").distinct()
    return p.select("symbol", "asset_class", rules.owner(F.col("symbol"), F.col("asset_class"), rules.REPORT_OWNERS).alias("report_owner"), rules.owner(F.col("symbol"), F.col("asset_class"), rules.BUDGET_OWNERS).alias("budget_owner"))


def unrealized_by_owner(s, d):
    return _r(ledger.unrealized_by_owner(fixtures.positions(s, d)), "unrealized_pl", "allocation")


def bot_performance(s, d):
    out = ledger.bot_performance(scans.tagged_union(_logs(s, d, REPORT_LOGS)), fixtures.positions(s, d))
    return _r(out, "allocation", "unrealized_pl", "realized_pl", "total_pl")


def _config(s):
    return documents.bots(documents.parse(fixtures.texts(s, fixtures.CONFIG), schemas.CONFIG))


def _processes(s):
    return documents.processes(fixtures.texts(s, fixtures.PROCESS_LIST))


def budget_check(s, d):
    return _r(ledger.budget_check(_config(s), fixtures.positions(s, d), fixtures.account(s)), "used")


def position_lookup(s, d):
    return scans.position_quantity(s.createDataFrame([("BTC/USD",), ("NVDA",), ("XXX",)], "symbol string"), fixtures.positions(s, d))


def latest_quote(s, d):
    q = fixtures.quotes(s, d)
    return scans.latest_quote(q, "bid").withColumnRenamed("price", "bid").join(scans.latest_quote(q, "ask").withColumnRenamed("price", "ask"), "symbol")


def _chain(s, d):
    return scans.option_chain(fixtures.contracts(s, d), F.lit("2024-01-01").cast("date"))


def contract_filter(s, d):
    out = scans.option_chain(fixtures.contracts(s, d), F.lit("2024-01-01").cast("date"), kind="PUT", underlying="Brand#11")
    return out.withColumn("expiration", F.col("expiration").cast("string"))


def _wheel(side):
    def run(s, d):
        return _r(options.wheel_strike(_chain(s, d), fixtures.spots(s, d), side), "score").withColumn("expiration", F.col("expiration").cast("string"))

    return run


def condor_legs(s, d):
    return _r(options.condor_legs(_chain(s, d), fixtures.spots(s, d)), "target", "diff")


def leg_pricing(s, d):
    legs = options.condor_legs(_chain(s, d), fixtures.spots(s, d)).select("underlying", "leg_no", "side", "symbol")
    return options.price_legs(legs, fixtures.quotes(s, d))


def take_profit(s, d):
    return _r(options.take_profit(fixtures.positions(s, d)), "capture", "fallback_limit")


def option_root(s, d):
    return options.option_roots(fixtures.positions(s, d))


def active_options(s, d):
    watch = s.createDataFrame([("DIS",), ("PLTR",), ("F",), ("TSLA",)], "ticker string")
    return options.active_options(watch, fixtures.positions(s, d))


def wheel_buying_power(s, d):
    c = fixtures.contracts(s, d).where("type = 'PUT'")
    k = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("bigint")
    return _r(options.spend_in_order(c.select(F.col("underlying").alias("account"), k.alias("ordinal"), (F.col("strike") * 100).alias("cost")), 300_000.0), "power_left")


def condor_candidate(s, d):
    found = options.condor_legs(_chain(s, d), fixtures.spots(s, d))
    order = fixtures.spots(s, d).select("underlying", F.regexp_extract("underlying", "([0-9]+)$", 1).cast("bigint").alias("ordinal"))
    active = s.createDataFrame([("Brand#11",), ("Brand#12",)], "root string")
    return options.first_condor(order, active, fixtures.spots(s, d).withColumnRenamed("spot", "price"), found, budgets=budget_check(s, d))


def close_orders(s, d):
    return _r(options.close_orders(fixtures.positions(s, d), fixtures.option_quotes(s, d)), "capture", "limit_price")


def _wheel_orders(side):
    def run(s, d):
        found = options.wheel_strike(_chain(s, d), fixtures.spots(s, d), side).withColumn("ordinal", F.regexp_extract("underlying", "([0-9]+)$", 1).cast("bigint"))
        return options.wheel_orders(found.withColumn("spot", F.lit(fixtures.SPOT)), fixtures.quotes(s, d), side, 400_000.0, budget_check(s, d))

    return run


def wheel_put_open(s, d):
    """The wheel's puts at a moment inside a session."""
    found = options.wheel_strike(_chain(s, d), fixtures.spots(s, d), "PUT").withColumn("ordinal", F.regexp_extract("underlying", "([0-9]+)$", 1).cast("bigint"))
    found = found.withColumn("spot", F.lit(fixtures.SPOT))
    now = F.lit("2024-01-02 15:00:00").cast("timestamp_ntz")
    return options.wheel_orders(found, fixtures.quotes(s, d), "PUT", 400_000.0, budget_check(s, d), now=now, calendar=fixtures.calendar(s))


#: Distances of the ladder from the price: 41 steps of a hundredth.
STEPS = [k / 100 for k in range(-20, 21)]


def strike_ladder(s, d):
    offsets = [(kind, k, kind.lower(), kind, step) for kind in ("PUT", "CALL") for k, step in enumerate(STEPS)]
    out = options.strike_ladder(_chain(s, d), fixtures.spots(s, d), offsets)
    return _r(out.select("underlying", F.col("side").alias("type"), "leg_no", "target", "symbol", "strike", "diff"), "target", "diff")


def owner_by_list(s, d):
    p = ledger.attribute_listed(fixtures.positions(s, d).select("symbol", "asset_class", "market_value"), ledger.listed_owners(s))
    return _r(p.groupBy("owner").agg(F.count("*").alias("n_positions"), F.sum("market_value").alias("allocation")), "allocation")


def wheel_closes(s, d):
    watch = s.createDataFrame([("DIS",), ("PLTR",), ("F",), ("TSLA",)], "ticker string")
    return _r(options.wheel_closes(watch, fixtures.positions(s, d), fixtures.option_quotes(s, d), share=0.0), "capture", "limit_price")


def trade_scan_dated(s, d):
    """The report's scan over logs written by month and read again."""
    path = sinks.work_folder(s, "log")
    sinks.write_dated(scans.tagged_union(_logs(s, d, REPORT_LOGS)), path, unit="month")
    return scans.dated_scan(s.read.parquet(path), F.lit(NOW).cast("timestamp"), 30, unit="month")


def export_names(s, d):
    days = scans.recent(scans.tagged_union(_logs(s, d, EXPORT_LOGS)), F.lit(NOW).cast("timestamp"), 7).select(F.to_date("time").alias("day")).distinct()
    return days.select(sinks.dated("trade_history", F.col("day")).alias("file"))


def csv_export(s, d):
    """The exported file, read again."""
    path = sinks.export_daily(trade_export(s, d), sinks.work_folder(s, "export"), "trade_history")
    return s.read.option("header", True).schema("time timestamp, symbol string, action string, price double, qty double, bot_type string").csv(path)


def log_lines(s, d):
    """The lines that a trade log's writer appends, read again."""
    rows = _logs(s, d, ["trades"])["trades"].select("symbol", F.lower("action").alias("action"), F.floor("price").alias("price"), F.col("qty").cast("int").alias("qty"))
    path = sinks.work_folder(s, "lines")
    sinks.write_lines(rows, path, "trades", ["symbol", "action"], ["price", "qty"])
    return s.read.text(path).withColumnRenamed("value", "line")


def target_document(s, d):
    """The list of targets as written and read again."""
    path = sinks.work_folder(s, "targets")
    held = fixtures.positions(s, d).where("asset_class = 'US_EQUITY'").select("symbol")
    sinks.write_json(sinks.target_document(held, F.lit(NOW)), path)
    return documents.read_json(s, path, schemas.TARGETS).select(F.explode("targets").alias("symbol"), "updated")


def fleet_reconcile(s, d):
    return fleet.reconcile(_config(s), _processes(s))


def emergency_stop(s, d):
    return fleet.emergency_stop(_processes(s))


def process_metrics(s, d):
    return fleet.process_metrics(_processes(s), F.lit(fixtures.NOW_MS), "host1")


def config_bots(s, d):
    return _config(s)


def target_list(s, d):
    docs = documents.parse(s.createDataFrame([('{"targets": ["AMD", "XOM"], "updated": "x"}',), ("not json",)], "value string"), schemas.TARGETS)
    return documents.targets(docs)


def watch_list(s, d):
    held = fixtures.positions(s, d).where("asset_class = 'US_EQUITY'").select("symbol")
    return signals.watch_list(s.createDataFrame([(x,) for x in rules.REPORT_OWNERS["survivor_bot"]], "symbol string"), target_list(s, d), held)


def line_protocol(s, d):
    rows = ledger.unrealized_by_owner(fixtures.positions(s, d)).select("bot", F.format_string("%.2f", F.round("allocation", 2)).alias("note"), F.lit(1).alias("n"))
    return sinks.line_protocol(rows, "bot_performance", ["bot"], ["note", "n"])


QUERIES = {
    "trades_union": trades_union, "trade_scan": trade_scan, "trade_export": trade_export, "epoch_times": epoch_times, "realized_pnl": realized_pnl, "owner_attribution": owner_attribution,
    "unrealized_by_owner": unrealized_by_owner, "bot_performance": bot_performance, "budget_check": budget_check, "position_lookup": position_lookup, "latest_quote": latest_quote,
    "contract_filter": contract_filter, "wheel_put": _wheel("PUT"), "wheel_call": _wheel("CALL"), "condor_legs": condor_legs, "leg_pricing": leg_pricing, "take_profit": take_profit, "option_root": option_root,
    "active_options": active_options, "wheel_put_open": wheel_put_open, "strike_ladder": strike_ladder, "owner_by_list": owner_by_list, "wheel_closes": wheel_closes, "trade_scan_dated": trade_scan_dated,
    "wheel_buying_power": wheel_buying_power, "condor_candidate": condor_candidate, "fleet_reconcile": fleet_reconcile, "emergency_stop": emergency_stop,
    "process_metrics": process_metrics, "config_bots": config_bots, "target_list": target_list, "close_orders": close_orders, "wheel_put_orders": _wheel_orders("PUT"), "wheel_call_orders": _wheel_orders("CALL"),
    "export_names": export_names, "csv_export": csv_export, "log_lines": log_lines, "target_document": target_document, "watch_list": watch_list, "line_protocol": line_protocol,
}

_LOG = "CASE l_linenumber % 7 WHEN 1 THEN 'trades' WHEN 2 THEN 'crypto_trades' WHEN 3 THEN 'survivor_trades' WHEN 4 THEN 'wheel_trades' WHEN 5 THEN 'condor_trades' ELSE 'breakout_trades' END"
_T = f"""t AS (SELECT l_shipdate AS time, 'SYM' || (l_suppkey % 10) AS symbol, CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'N' THEN 'Grid_SELL' ELSE 'startup' END AS action, l_extendedprice / l_quantity AS price,
  CASE WHEN l_linenumber % 7 IN (4, 5) THEN NULL ELSE l_quantity END AS qty, {_LOG} AS bot_type FROM lineitem)"""
_names = lambda x: "(" + ", ".join(f"'{n}'" for n in x) + ")"
_P = f"""p AS (SELECT list_value({", ".join(f"'{h}'" for h in fixtures.HELD)})[c_custkey % 10 + 1] AS symbol, CASE WHEN c_custkey % 10 = 5 THEN 'CRYPTO' WHEN c_custkey % 10 BETWEEN 6 AND 8 THEN 'US_OPTION' ELSE 'US_EQUITY' END AS asset_class,
  (c_custkey % 21 - 10)::DOUBLE AS qty, (c_custkey % 50)::DOUBLE AS avg_entry_price, (c_custkey % 37 + 1)::DOUBLE AS current_price, c_acctbal AS market_value, c_acctbal * 0.1::DOUBLE AS unrealized_pl, c_custkey AS ordinal FROM customer)"""


def _owner_sql(survivors) -> str:
    wheel = " OR ".join(f"starts_with(symbol, '{t}')" for t in rules.BUDGET_OWNERS["wheel_bot"])
    return f"CASE WHEN asset_class = 'CRYPTO' THEN 'crypto_grid' WHEN asset_class = 'US_OPTION' THEN CASE WHEN {wheel} THEN 'wheel_bot' ELSE 'condor_bot' END WHEN symbol IN {_names(survivors)} THEN 'survivor_bot' WHEN symbol IN {_names(rules.BUDGET_OWNERS['wheel_bot'])} THEN 'wheel_bot' ELSE 'trend_bot' END"


_OR, _OB = _owner_sql(rules.REPORT_OWNERS["survivor_bot"]), _owner_sql(rules.BUDGET_OWNERS["survivor_bot"])
_BOTS = ", ".join(f"('{b}')" for b in rules.REPORT_BOTS)
_REAL = f"""{_T}, s AS (SELECT bot_type, coalesce(sum(CASE WHEN contains(lower(action), 'buy') THEN price * qty END), 0) AS bv, coalesce(sum(CASE WHEN contains(lower(action), 'sell') THEN price * qty END), 0) AS sv,
  coalesce(sum(CASE WHEN contains(lower(action), 'buy') THEN qty END), 0) AS b, coalesce(sum(CASE WHEN contains(lower(action), 'sell') THEN qty END), 0) AS q FROM t WHERE bot_type IN {_names(REPORT_LOGS)} GROUP BY 1),
real AS (SELECT CASE bot_type WHEN 'crypto_trades' THEN 'crypto_grid' WHEN 'survivor_trades' THEN 'survivor_bot' WHEN 'wheel_trades' THEN 'wheel_bot' WHEN 'condor_trades' THEN 'condor_bot' ELSE 'trend_bot' END AS bot,
  CASE WHEN b > 0 AND q > 0 THEN sv - bv / b * q ELSE 0.0::DOUBLE END AS realized_pl FROM s)"""
_UNREAL = f"""{_P}, h AS (SELECT {_OR} AS bot, sum(unrealized_pl) AS u, sum(market_value) AS a FROM p GROUP BY 1), un AS (SELECT bot, coalesce(u, 0) AS unrealized_pl, coalesce(a, 0) AS allocation FROM (VALUES {_BOTS}) AS d(bot) LEFT JOIN h USING (bot))"""
_C = """c AS (SELECT p_brand || '-' || p_partkey AS symbol, p_brand AS underlying, CASE WHEN p_partkey % 2 = 0 THEN 'PUT' ELSE 'CALL' END AS type, (DATE '2024-01-01' + p_size::INTEGER) AS expiration,
  round((p_retailprice - 900.0::DOUBLE) * 9 + 500.0, 2) AS strike, 'active' AS status, p_size, p_partkey FROM part)"""
_CONFIG = """cfg(bot, script, status, strategy, allocation) AS (VALUES ('crypto_grid', NULL, 'active', NULL, 0.2::DOUBLE), ('survivor_bot', NULL, 'active', NULL, 0.5), ('wheel_bot', NULL, 'paused', 'puts on dips', 0.0),
  ('trend_bot', NULL, 'active', NULL, 9000.0), ('moon_bag', NULL, 'paused', NULL, 4000.0), ('condor_bot', NULL, 'active', NULL, 0.0), ('event_watch', 'jobs/events', 'active', 'report bursts of clicks', 0.0))"""
_PROC = """pr(ordinal, name, status, memory, cpu, restarts, up) AS (VALUES (0, 'crypto_grid', 'stopped', 0::BIGINT, 0.0::DOUBLE, 1::BIGINT, NULL::BIGINT), (1, 'crypto_grid', 'online', 1000, 1.5, 2, 1700000000000),
  (2, 'survivor_bot', 'stopped', 10, 0.0, 7, 1700000000000), (3, 'wheel_bot', 'online', 0, 0.0, 0, 1700000500000), (4, 'condor_bot', 'errored', 0, 0.0, 0, NULL), (5, 'supervisor', 'online', 5, 0.5, 1, 1700000900000))"""
_EXPORTED = f"{_T} SELECT time - INTERVAL 5 HOUR AS time, symbol, action, price, qty, bot_type FROM t WHERE bot_type IN {_names(EXPORT_LOGS)} AND time > TIMESTAMP '{NOW}' - INTERVAL 7 DAY"


def _wheel_sql(side: str) -> str:
    return f"""WITH {_C}, x AS (SELECT *, abs(abs(950.0::DOUBLE - strike) / 950.0 - 0.05) AS score FROM c WHERE p_size BETWEEN 25 AND 45 AND type = '{side}' AND strike {'<' if side == 'PUT' else '>'} 950.0)
SELECT underlying, symbol, expiration::VARCHAR AS expiration, strike, round(score, 4) AS score FROM x WHERE score < 1.0 QUALIFY row_number() OVER (PARTITION BY underlying ORDER BY score, expiration, strike, symbol) = 1"""


_LEGS = f"""{_C}, l(leg_no, leg, kind, side, off) AS (VALUES (0, 'put_long', 'PUT', 'BUY', -0.13::DOUBLE), (1, 'call_long', 'CALL', 'BUY', 0.13), (2, 'put_short', 'PUT', 'SELL', -0.08), (3, 'call_short', 'CALL', 'SELL', 0.08)),
x AS (SELECT underlying, leg_no, leg, side, 950.0::DOUBLE * (1 + off) AS target, symbol, strike, abs(strike - 950.0::DOUBLE * (1 + off)) AS diff, p_partkey FROM c JOIN l ON type = kind WHERE p_size BETWEEN 25 AND 45
  QUALIFY row_number() OVER (PARTITION BY underlying, leg_no ORDER BY abs(strike - 950.0::DOUBLE * (1 + off)), expiration, strike, symbol) = 1),
legs AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY underlying) = 4)"""

SQL = {
    "trades_union": f"WITH {_T} SELECT time, symbol, action, price, qty, bot_type FROM t",
    "trade_scan": f"WITH {_T} SELECT time, symbol, action, price, qty, bot_type FROM t WHERE bot_type IN {_names(REPORT_LOGS)} AND time > TIMESTAMP '{NOW}' - INTERVAL 30 DAY",
    "strike_ladder": f"""WITH {_C}, l AS (SELECT type, k AS leg_no, (k - 20) / 100.0::DOUBLE AS off FROM range(41) AS r(k), (VALUES ('PUT'), ('CALL')) AS t(type)),
  x AS (SELECT underlying, type, leg_no::INTEGER AS leg_no, 950.0::DOUBLE * (1 + off) AS target, symbol, strike, expiration, abs(strike - 950.0::DOUBLE * (1 + off)) AS diff FROM c JOIN l USING (type) WHERE p_size BETWEEN 25 AND 45)
  SELECT underlying, type, leg_no, round(target, 4) AS target, symbol, strike, round(diff, 4) AS diff FROM x QUALIFY row_number() OVER (PARTITION BY underlying, type, leg_no ORDER BY diff, expiration, strike, symbol) = 1""",
    "owner_by_list": f"WITH {_P} SELECT {_OB} AS owner, count(*) AS n_positions, round(sum(market_value), 4) AS allocation FROM p GROUP BY 1",
    "wheel_closes": f"""WITH {_P}, o AS (SELECT ticker, p.* FROM (VALUES ('DIS'), ('PLTR'), ('F'), ('TSLA')) AS w(ticker) JOIN p ON asset_class = 'US_OPTION' AND starts_with(symbol, ticker) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ordinal DESC) = 1),
  q AS (SELECT symbol, arg_max((ordinal % 4) / 10.0::DOUBLE, ordinal) AS ask FROM p WHERE asset_class = 'US_OPTION' GROUP BY 1)
  SELECT ticker, o.symbol, round((avg_entry_price - current_price) / avg_entry_price, 4) AS capture, abs(trunc(qty)::BIGINT) AS close_qty, round(CASE WHEN ask = 0 THEN current_price * 1.05::DOUBLE ELSE ask END, 4) AS limit_price
  FROM o JOIN q ON q.symbol = o.symbol WHERE avg_entry_price > 0 AND (avg_entry_price - current_price) / avg_entry_price >= 0""",
    "trade_scan_dated": f"WITH {_T} SELECT time, symbol, action, price, qty, bot_type FROM t WHERE bot_type IN {_names(REPORT_LOGS)} AND time > TIMESTAMP '{NOW}' - INTERVAL 30 DAY",
    "trade_export": f"WITH {_EXPORTED}",
    "csv_export": f"WITH {_EXPORTED}",
    "epoch_times": "SELECT event_id AS id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events",
    "realized_pnl": f"WITH {_REAL} SELECT bot, round(realized_pl, 4) AS realized_pl FROM real",
    "owner_attribution": f"WITH {_P} SELECT DISTINCT symbol, asset_class, {_OR} AS report_owner, {_OB} AS budget_owner FROM p",
    "unrealized_by_owner": f"WITH {_UNREAL} SELECT bot, round(unrealized_pl, 4) AS unrealized_pl, round(allocation, 4) AS allocation FROM un",
    "bot_performance": f"WITH {_REAL}, {_UNREAL} SELECT bot, round(allocation, 4) AS allocation, round(unrealized_pl, 4) AS unrealized_pl, round(coalesce(realized_pl, 0), 4) AS realized_pl, round(unrealized_pl + coalesce(realized_pl, 0), 4) AS total_pl FROM un LEFT JOIN real USING (bot)",
    "budget_check": f"""WITH {_P}, {_CONFIG}, u AS (SELECT {_OB} AS o, sum(market_value) AS used FROM p GROUP BY 1) SELECT bot, allocation, round(coalesce(used, 0), 4) AS used,
  CASE WHEN allocation = 0 THEN true ELSE 100000.0 * allocation - coalesce(used, 0) > 0 END AS allowed FROM cfg LEFT JOIN u ON o = CASE WHEN bot = 'moon_bag' THEN 'crypto_grid' ELSE bot END""",
    "position_lookup": f"WITH {_P} SELECT s.symbol, coalesce(sum(qty), 0.0::DOUBLE) AS qty FROM (VALUES ('BTC/USD'), ('NVDA'), ('XXX')) AS s(symbol) LEFT JOIN p ON p.symbol = replace(s.symbol, '/', '') GROUP BY 1",
    "latest_quote": f"WITH {_C} SELECT symbol, (p_partkey % 40) / 100.0::DOUBLE AS bid, (p_partkey % 40) / 100.0::DOUBLE + 0.05::DOUBLE AS ask FROM c",
    "contract_filter": f"WITH {_C} SELECT symbol, underlying, type, expiration::VARCHAR AS expiration, strike, status FROM c WHERE p_size BETWEEN 25 AND 45 AND type = 'PUT' AND underlying = 'Brand#11'",
    "wheel_put": _wheel_sql("PUT"),
    "wheel_call": _wheel_sql("CALL"),
    "condor_legs": f"WITH {_LEGS} SELECT underlying, leg_no, leg, side, round(target, 4) AS target, symbol, strike, round(diff, 4) AS diff FROM legs",
    "leg_pricing": f"WITH {_LEGS}, q AS (SELECT *, CASE side WHEN 'BUY' THEN (p_partkey % 40) / 100.0::DOUBLE + 0.05::DOUBLE ELSE (p_partkey % 40) / 100.0::DOUBLE END AS v FROM legs) SELECT underlying, leg_no, side, symbol, CASE WHEN v <= 0.01 THEN 0.05::DOUBLE ELSE v END AS limit_price FROM q",
    "take_profit": f"WITH {_P}, k AS (SELECT *, (avg_entry_price - current_price) / avg_entry_price AS capture FROM p WHERE asset_class = 'US_OPTION' AND qty < 0 AND avg_entry_price > 0) SELECT symbol, round(capture, 4) AS capture, abs(trunc(qty)::BIGINT) AS close_qty, round(current_price * 1.05::DOUBLE, 4) AS fallback_limit FROM k WHERE capture >= 0.5",
    "close_orders": f"""WITH {_P}, q AS (SELECT symbol, arg_max((ordinal % 4) / 10.0::DOUBLE, ordinal) AS ask FROM p WHERE asset_class = 'US_OPTION' GROUP BY 1),
  k AS (SELECT p.*, {_OB} AS owner, (avg_entry_price - current_price) / avg_entry_price AS capture FROM p WHERE asset_class = 'US_OPTION' AND avg_entry_price > 0)
  SELECT k.symbol, owner, round(capture, 4) AS capture, abs(trunc(qty)::BIGINT) AS close_qty, round(CASE WHEN owner = 'condor_bot' THEN coalesce(ask, 0) * 1.05::DOUBLE WHEN coalesce(ask, 0) = 0 THEN current_price * 1.05::DOUBLE ELSE ask END, 4) AS limit_price
  FROM k LEFT JOIN q USING (symbol) WHERE capture >= 0.5 AND (owner = 'wheel_bot' OR qty < 0)""",
    "wheel_put_orders": f"""WITH RECURSIVE {_C}, {_P}, x AS (SELECT *, abs(abs(950.0::DOUBLE - strike) / 950.0 - 0.05) AS score FROM c WHERE p_size BETWEEN 25 AND 45 AND type = 'PUT' AND strike < 950.0),
  b AS (SELECT *, (p_partkey % 40) / 100.0::DOUBLE AS bid, regexp_extract(underlying, '([0-9]+)$', 1)::BIGINT AS ordinal FROM x WHERE score < 1.0 QUALIFY row_number() OVER (PARTITION BY underlying ORDER BY score, expiration, strike, symbol) = 1),
  r AS (SELECT *, row_number() OVER (ORDER BY ordinal, strike) AS rn FROM b WHERE bid >= 0.1),
  f(rn, underlying, symbol, bid, ok, power) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, false, 400000.0::DOUBLE UNION ALL
    SELECT r.rn, r.underlying, r.symbol, r.bid, f.power >= greatest(r.strike * 100, 95000.0), CASE WHEN f.power >= greatest(r.strike * 100, 95000.0) THEN f.power - r.strike * 100 ELSE f.power END FROM f JOIN r ON r.rn = f.rn + 1)
  SELECT underlying, symbol, bid AS limit_price FROM f WHERE ok""",
    "wheel_call_orders": f"""WITH {_C}, x AS (SELECT *, abs(abs(950.0::DOUBLE - strike) / 950.0 - 0.05) AS score FROM c WHERE p_size BETWEEN 25 AND 45 AND type = 'CALL' AND strike > 950.0),
  b AS (SELECT *, (p_partkey % 40) / 100.0::DOUBLE AS bid FROM x WHERE score < 1.0 QUALIFY row_number() OVER (PARTITION BY underlying ORDER BY score, expiration, strike, symbol) = 1)
  SELECT underlying, symbol, bid AS limit_price FROM b WHERE bid >= 0.1""",
    "export_names": f"WITH {_T} SELECT DISTINCT 'trade_history_' || strftime(time, '%Y%m%d') || '.csv' AS file FROM t WHERE bot_type IN {_names(EXPORT_LOGS)} AND time > TIMESTAMP '{NOW}' - INTERVAL 7 DAY",
    "log_lines": f"WITH {_T} SELECT printf('trades,symbol=%s,action=%s price=%d,qty=%d', symbol, lower(action), floor(price)::BIGINT, qty::INTEGER) AS line FROM t WHERE bot_type = 'trades'",
    "target_document": f"WITH {_P} SELECT DISTINCT symbol, '{NOW}' AS updated FROM p WHERE asset_class = 'US_EQUITY'",
    "option_root": f"WITH {_P}, r AS (SELECT regexp_extract(symbol, '^([^0-9]*)', 1) AS root FROM p WHERE asset_class = 'US_OPTION') SELECT root, count(*) AS n_positions FROM r WHERE NOT (starts_with(root, 'DIS') OR starts_with(root, 'F') OR starts_with(root, 'PLTR')) GROUP BY 1",
    "active_options": f"""WITH {_P}, o AS (SELECT ticker, arg_max(symbol, ordinal) AS option FROM (VALUES ('DIS'), ('PLTR'), ('F'), ('TSLA')) AS w(ticker) JOIN p ON asset_class = 'US_OPTION' AND starts_with(symbol, ticker) GROUP BY 1),
  k AS (SELECT symbol AS ticker, arg_max(qty, ordinal) AS q FROM p WHERE asset_class = 'US_EQUITY' GROUP BY 1)
  SELECT w.ticker, option, coalesce(q, 0.0::DOUBLE) AS stock_qty, CASE WHEN option IS NULL THEN CASE WHEN coalesce(q, 0) >= 100 THEN 'CALL' ELSE 'PUT' END END AS side FROM (VALUES ('DIS'), ('PLTR'), ('F'), ('TSLA')) AS w(ticker) LEFT JOIN o USING (ticker) LEFT JOIN k USING (ticker)""",
    "wheel_buying_power": f"""WITH RECURSIVE {_C}, r AS (SELECT underlying AS account, p_partkey AS ordinal, strike * 100 AS cost, row_number() OVER (PARTITION BY underlying ORDER BY p_partkey) AS rn FROM c WHERE type = 'PUT'),
  f(account, ordinal, rn, accepted, power) AS (SELECT DISTINCT account, NULL::BIGINT, 0::BIGINT, false, 300000.0::DOUBLE FROM r UNION ALL SELECT r.account, r.ordinal, r.rn, f.power >= r.cost, CASE WHEN f.power >= r.cost THEN f.power - r.cost ELSE f.power END FROM f JOIN r ON r.account = f.account AND r.rn = f.rn + 1)
  SELECT account, ordinal, accepted, round(power, 4) AS power_left FROM f WHERE rn > 0""",
    "condor_candidate": f"WITH {_LEGS} SELECT DISTINCT underlying, regexp_extract(underlying, '([0-9]+)$', 1)::BIGINT AS ordinal, 950.0::DOUBLE AS price FROM legs WHERE underlying NOT IN ('Brand#11', 'Brand#12') ORDER BY ordinal LIMIT 1",
    "fleet_reconcile": f"""WITH {_CONFIG}, {_PROC}, j AS (SELECT bot, cfg.status AS desired, coalesce(pr.status, 'missing') AS actual FROM cfg LEFT JOIN (SELECT name, arg_max(status, ordinal) AS status FROM pr GROUP BY 1) AS pr ON name = bot)
  SELECT *, CASE WHEN desired = 'active' AND actual = 'missing' THEN 'start' WHEN desired = 'active' AND actual IN ('stopped', 'errored') THEN 'restart' WHEN desired = 'paused' AND actual = 'online' THEN 'stop' END AS command FROM j""",
    "emergency_stop": f"WITH {_PROC} SELECT name AS bot, 'stop' AS command FROM pr WHERE status = 'online' AND name <> 'supervisor'",
    "process_metrics": f"WITH {_PROC} SELECT 'host1' AS host, name AS bot, CASE WHEN status = 'online' THEN 1 ELSE 0 END AS status_code, memory, cpu, restarts, CASE WHEN status = 'online' THEN {fixtures.NOW_MS} - up ELSE 0 END::BIGINT AS uptime FROM pr",
    "config_bots": f"WITH {_CONFIG} SELECT *, 'calm' AS market_condition, false AS emergency_stop FROM cfg",
    "target_list": "SELECT * FROM (VALUES ('AMD'), ('XOM')) AS t(symbol)",
    "watch_list": f"WITH {_P} SELECT symbol FROM p WHERE asset_class = 'US_EQUITY' UNION SELECT * FROM (VALUES ('AMD'), ('XOM'), ('TQQQ'), ('SQQQ'), ('SOXL'), ('SOXS'), ('FNGU'), ('UPRO')) AS v(symbol)",
    "line_protocol": f"WITH {_UNREAL} SELECT printf('bot_performance,bot=%s note=\"%.2f\",n=1', bot, round(allocation, 2)) AS line FROM un",
}
SQL["wheel_put_open"] = SQL["wheel_put_orders"]
