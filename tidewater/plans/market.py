"""Registered queries over bars: scans, indicators, regimes and signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import indicators as ind
from ..functions import rules
from ..operators import fleet, grid, ledger, signals
from ..sources import documents, fixtures, scans

R = 4


def _r(df, *cols):
    """Rounded for comparison; means of 200 prices in cents have ties at four places, so they keep six."""
    return df.withColumns({c: F.round(c, 6 if c in ("sma200", "ema200", "ema500") else R) for c in cols})


def _bars(width):
    return lambda s, d: fixtures.bars(s, d, width)


def latest_trade(s, d):
    return scans.latest_trade(fixtures.ticks(s, d))


def latest_bar(s, d):
    return scans.latest_bar(fixtures.bars(s, d))


def history(s, d):
    return scans.history(fixtures.bars(s, d, "15 minutes"), ["click", "view"], F.lit("2024-01-10").cast("timestamp_ntz"), 200)


def history_eastern(s, d):
    out = scans.history(fixtures.bars(s, d), ["click"], limit=30, take="earliest", eastern=True)
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("eastern"), rules.market_hours(F.col("ts")).alias("in_hours"), "close")


def finished_bars(s, d):
    return scans.finished(fixtures.bars(s, d, "1 day"))


def sma(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.sma(200)).select("symbol", "ts", "sma200"), "sma200")


def donchian(s, d):
    return ind.enrich(fixtures.bars(s, d, "1 day"), ind.donchian()).select("symbol", "ts", "entry_high", "exit_low")


def returns(s, d):
    return _r(ind.enrich(fixtures.bars(s, d, "1 day"), ind.returns()).select("symbol", "ts", "move"), "move")


def sector_hot(s, d):
    return _r(signals.sector_moves(fixtures.bars(s, d, "1 day")), "move_pct")


def sector_targets(s, d):
    members = {"click": ("AAA", "BBB"), "view": ("BBB", "CCC"), "purchase": ("DDD",)}
    return signals.sector_targets(signals.sector_moves(fixtures.bars(s, d, "1 day")), members)


def ema(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.ema(9), ind.ema(21)).select("symbol", "ts", "ema9", "ema21"), "ema9", "ema21")


def rsi(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.rsi()).select("symbol", "ts", "rsi"), "rsi")


def ema_200(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.ema(200)).select("symbol", "ts", "ema200"), "ema200")


def ema_500(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.ema(500), chunk=64).select("symbol", "ts", "ema500"), "ema500")


def channel_400(s, d):
    """Windows of many chunks: mean and extremes of the last 400 hours."""
    rows = ind.enrich(fixtures.bars(s, d), ind.sma(400), ind.donchian(400, 300))
    return rows.select("symbol", "ts", F.round("sma400", 6).alias("sma400"), "entry_high", "exit_low")


def rsi_2(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.rsi(2, into="rsi2")).select("symbol", "ts", "rsi2"), "rsi2")


def adx(s, d):
    return _r(ind.enrich(fixtures.bars(s, d), ind.adx()).select("symbol", "ts", "adx"), "adx")


def ema_cross(s, d):
    rows = ind.enrich(fixtures.bars(s, d), ind.ema(9), ind.ema(21), ind.crossings("ema9", "ema21"))
    return rows.select("symbol", "ts", "bull_cross", "bear_cross")


def regime(s, d):
    return _r(signals.regimes(fixtures.bars(s, d)), "sma200", "adx")


def regime_latest(s, d):
    return _r(ind.latest(signals.regimes(fixtures.bars(s, d))), "sma200", "adx")


def regime_playbook_diff(s, d):
    return fleet.playbook_diff(signals.regimes(fixtures.bars(s, d)), documents.bots(documents.parse(fixtures.texts(s, fixtures.CONFIG), schemas.CONFIG)))


def _budgets(s, d):
    return ledger.budget_check(documents.bots(documents.parse(fixtures.texts(s, fixtures.CONFIG), schemas.CONFIG)), fixtures.positions(s, d), fixtures.account(s))


def trend_signals(s, d):
    out = signals.trend_signals(fixtures.bars(s, d), fixtures.event_positions(s), fixtures.account(s), fixtures.symbols(s), "CHOP", _budgets(s, d), every=True)
    return _r(out.where("action is not null").select("symbol", "ts", "price", "adx", "action", "qty"), "adx")


def trend_open(s, d):
    """Signals on 15-minute bars inside sessions; one symbol is a crypto pair, which the trend follower leaves alone."""
    bars = fixtures.bars(s, d, "15 minutes").withColumn("symbol", F.when(F.col("symbol") == "error", "BTC/USD").otherwise(F.col("symbol")))
    listed = fixtures.symbols(s, ("purchase", "signup", "BTC/USD"))
    out = signals.trend_signals(bars, fixtures.event_positions(s), fixtures.account(s), listed, "CHOP", _budgets(s, d), every=True, calendar=fixtures.calendar(s))
    return _r(out.where("action is not null").select("symbol", "ts", "price", "adx", "action", "qty"), "adx")


def survivor_signals(s, d):
    out = signals.survivor_signals(fixtures.bars(s, d), fixtures.event_positions(s), fixtures.account(s), fixtures.symbols(s, ("purchase",)), _budgets(s, d), every=True)
    return _r(out.where("action is not null").select("symbol", "ts", "price", "rsi", "action", "reason", "qty"), "rsi")


def market_open(s, d):
    return signals.while_open(fixtures.bars(s, d, "15 minutes"), fixtures.calendar(s)).select("symbol", "ts", "close")


def breakout_signals(s, d):
    held = fixtures.event_positions(s).where("qty > 0")
    out = signals.breakout_signals(fixtures.bars(s, d), held, fixtures.account(s), every=True)
    return _r(out.where("action is not null"), "qty")


def position_sizing(s, d):
    return _r(signals.sizes(scans.latest_trade(fixtures.ticks(s, d)), fixtures.account(s)), "breakout_qty", "grid_qty")


def _clicks(s, d):
    return fixtures.ticks(s, d).where("symbol = 'click'")


def grid_zones(s, d):
    return _clicks(s, d).select("id", "price", rules.grid_zone(F.col("price"), **fixtures.GRID).alias("zone"))


def grid_signals(s, d):
    return _r(grid.grid_signals(_clicks(s, d), **fixtures.GRID).where("action is not null").select("id", "zone", "action", "qty"), "qty")


def grid_inventory(s, d):
    return _r(grid.grid_inventory(_clicks(s, d), **fixtures.GRID), "held")


QUERIES = {
    "bars_hourly": _bars("1 hour"), "bars_daily": _bars("1 day"), "bars_15m": _bars("15 minutes"), "latest_trade": latest_trade, "latest_bar": latest_bar, "history": history,
    "history_eastern": history_eastern, "finished_bars": finished_bars, "sma": sma, "donchian": donchian, "returns": returns, "sector_hot": sector_hot, "sector_targets": sector_targets,
    "ema": ema, "rsi": rsi, "adx": adx, "ema_200": ema_200, "ema_500": ema_500, "channel_400": channel_400, "rsi_2": rsi_2, "ema_cross": ema_cross, "regime": regime, "regime_latest": regime_latest, "regime_playbook_diff": regime_playbook_diff, "trend_signals": trend_signals, "trend_open": trend_open,
    "survivor_signals": survivor_signals, "breakout_signals": breakout_signals, "position_sizing": position_sizing, "market_open": market_open, "grid_zones": grid_zones, "grid_signals": grid_signals, "grid_inventory": grid_inventory,
}


def bars_sql(width: str, name: str = "bars") -> str:
    return f"""{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{width}', events.ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY events.ts, event_id) AS close FROM events GROUP BY 1, 2)"""


#: Numbered hourly bars with differences; every recursion below goes from row to row.
ROWS = "WITH RECURSIVE " + bars_sql("1 hour") + """,
n AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS d, high - lag(high) OVER w AS u, lag(low) OVER w - low AS v,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 THEN avg(close) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma200 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
rws AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS m FROM n)"""


def _ema_sql(n: int) -> str:
    a = f"(2.0::DOUBLE / {n + 1})"
    return f"""e{n}(symbol, rn, x) AS (SELECT symbol, {n}::BIGINT, avg(close) FROM rws WHERE rn <= {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT r.symbol, r.rn, {a} * r.close + (1 - {a}) * e.x FROM e{n} AS e JOIN rws AS r ON r.symbol = e.symbol AND r.rn = e.rn + 1)"""


def _rsi_sql(n: int) -> str:
    keep = f"({n - 1}.0::DOUBLE / {n})"
    return f"""g(symbol, rn, nu, nd) AS (SELECT symbol, rn, up, dn FROM rws WHERE rn = 2
  UNION ALL SELECT r.symbol, r.rn, r.up + {keep} * g.nu, r.dn + {keep} * g.nd FROM g JOIN rws AS r ON r.symbol = g.symbol AND r.rn = g.rn + 1),
rsi AS (SELECT symbol, rn, CASE WHEN rn >= {n + 1} THEN 100 * nu / nullif(nu + nd, 0) END AS rsi FROM g)"""


_K = "(13.0::DOUBLE / 14)"
_RSI = _rsi_sql(14)
_ADX = f"""q(symbol, rn, np, nm) AS (SELECT symbol, rn, p, m FROM rws WHERE rn = 2
  UNION ALL SELECT r.symbol, r.rn, r.p + {_K} * q.np, r.m + {_K} * q.nm FROM q JOIN rws AS r ON r.symbol = q.symbol AND r.rn = q.rn + 1),
dx AS (SELECT symbol, rn, 100 * abs(np - nm) / nullif(np + nm, 0) AS x FROM q WHERE rn >= 15),
ax(symbol, rn, num, den) AS (SELECT symbol, rn, x, 1.0::DOUBLE FROM dx WHERE rn = 15
  UNION ALL SELECT dx.symbol, dx.rn, dx.x + {_K} * ax.num, 1 + {_K} * ax.den FROM ax JOIN dx ON dx.symbol = ax.symbol AND dx.rn = ax.rn + 1),
adx AS (SELECT symbol, rn, CASE WHEN rn >= 28 THEN num / den END AS adx FROM ax)"""
_REGIME = "CASE WHEN adx > 25 AND close > sma200 THEN 'BULL_TREND' WHEN adx > 25 THEN 'BEAR_TREND' ELSE 'CHOP' END AS regime"
_ALL = f"{ROWS}, {_RSI}, {_ADX}, reg AS (SELECT rws.*, adx, {_REGIME} FROM rws LEFT JOIN adx USING (symbol, rn))"
_CROSS = f"""{ROWS}, {_ema_sql(9)}, {_ema_sql(21)}, {_ADX}, j AS (SELECT rws.*, e9.x AS f, e21.x AS s, adx FROM rws LEFT JOIN e9 USING (symbol, rn) LEFT JOIN e21 USING (symbol, rn) LEFT JOIN adx USING (symbol, rn)),
c AS (SELECT *, coalesce(f > s AND lag(f) OVER w <= lag(s) OVER w, false) AS bull_cross, coalesce(f < s AND lag(f) OVER w >= lag(s) OVER w, false) AS bear_cross FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
_MOVES = f"WITH {bars_sql('1 day')}, mv AS (SELECT symbol, ts, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS move FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), lm AS (SELECT symbol, last(move ORDER BY ts) AS move FROM mv GROUP BY symbol)"
_ZONE = "CASE WHEN value < 10 THEN -1 WHEN value > 85 THEN 6 ELSE trunc((value - 10.0) / 12.5)::INTEGER END"
_GRID = f"""WITH RECURSIVE z AS (SELECT event_id AS id, value AS price, {_ZONE} AS zone, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click' AND value <> 0)"""
#: What is left of a bot's share of the equity, as budgets see it (amounts as ``fixtures`` has them).
_SURVIVORS = ", ".join(f"'{t}'" for t in rules.BUDGET_OWNERS["survivor_bot"])
_HELD = f"SELECT list_value({', '.join(repr(h) for h in fixtures.HELD)})[c_custkey % 10 + 1] AS symbol, c_custkey % 10 AS k, c_acctbal AS v FROM customer"
_USED = f"""gate AS (SELECT 100000.0 * 0.5 - coalesce(sum(v) FILTER (k < 5 AND symbol IN ({_SURVIVORS}) OR k = 9 AND symbol IN ({_SURVIVORS})), 0) > 0 AS survivor,
  100000.0 * 9000.0 - coalesce(sum(v) FILTER ((k < 5 OR k = 9) AND symbol NOT IN ({_SURVIVORS}) AND symbol NOT IN ('DIS', 'F', 'PLTR')), 0) > 0 AS trend FROM ({_HELD}))"""
_PLAYS = ", ".join(f"('{r}', '{b}', '{v}')" for r, p in rules.PLAYBOOK.items() for b, v in p.items())

SQL = {
    "bars_hourly": f"WITH {bars_sql('1 hour')} SELECT * FROM bars",
    "bars_daily": f"WITH {bars_sql('1 day')} SELECT * FROM bars",
    "bars_15m": f"WITH {bars_sql('15 minutes')} SELECT * FROM bars",
    "latest_trade": "SELECT event_type AS symbol, last(value ORDER BY events.ts, event_id) AS price, max(events.ts) AS ts FROM events GROUP BY 1",
    "latest_bar": f"WITH {bars_sql('1 hour')} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "history": f"WITH {bars_sql('15 minutes')} SELECT * FROM bars WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 200",
    "history_eastern": f"WITH {bars_sql('1 hour')}, t AS (SELECT * FROM bars WHERE symbol = 'click' QUALIFY row_number() OVER (ORDER BY ts) <= 30) SELECT symbol, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS eastern, hour(ts - INTERVAL 5 HOUR) BETWEEN 8 AND 17 AS in_hours, close FROM t",
    "finished_bars": f"WITH {bars_sql('1 day')} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) > 1",
    "sma": f"{ROWS} SELECT symbol, ts, round(sma200, 6) AS sma200 FROM rws",
    "donchian": f"""WITH {bars_sql('1 day')} SELECT symbol, ts, CASE WHEN row_number() OVER w > 20 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS entry_high,
  CASE WHEN row_number() OVER w > 20 THEN min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS exit_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "returns": f"{_MOVES} SELECT symbol, ts, round(move, 4) AS move FROM mv",
    "sector_hot": f"{_MOVES} SELECT symbol AS sector, round(move, 4) AS move_pct, coalesce(abs(move) >= 0.02, false) AS hot FROM lm",
    "sector_targets": f"{_MOVES} SELECT DISTINCT s AS symbol FROM (VALUES ('click', 'AAA'), ('click', 'BBB'), ('view', 'BBB'), ('view', 'CCC'), ('purchase', 'DDD')) AS v(k, s) JOIN lm ON lm.symbol = k WHERE abs(move) >= 0.02 UNION SELECT * FROM (VALUES ('SPY'), ('QQQ'), ('IWM')) AS b(symbol)",
    "ema": f"{ROWS}, {_ema_sql(9)}, {_ema_sql(21)} SELECT symbol, ts, round(e9.x, 4) AS ema9, round(e21.x, 4) AS ema21 FROM rws LEFT JOIN e9 USING (symbol, rn) LEFT JOIN e21 USING (symbol, rn)",
    "rsi": f"{ROWS}, {_RSI} SELECT symbol, ts, round(rsi, 4) AS rsi FROM rws LEFT JOIN rsi USING (symbol, rn)",
    "ema_200": f"{ROWS}, {_ema_sql(200)} SELECT symbol, ts, round(e200.x, 6) AS ema200 FROM rws LEFT JOIN e200 USING (symbol, rn)",
    "ema_500": f"{ROWS}, {_ema_sql(500)} SELECT symbol, ts, round(e500.x, 6) AS ema500 FROM rws LEFT JOIN e500 USING (symbol, rn)",
    "channel_400": f"""WITH {bars_sql('1 hour')} SELECT symbol, ts, CASE WHEN row_number() OVER w >= 400 THEN round(avg(close) OVER (w ROWS BETWEEN 399 PRECEDING AND CURRENT ROW), 6) END AS sma400,
  CASE WHEN row_number() OVER w > 400 THEN max(high) OVER (w ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING) END AS entry_high,
  CASE WHEN row_number() OVER w > 400 THEN min(low) OVER (w ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING) END AS exit_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "rsi_2": f"{ROWS}, {_rsi_sql(2)} SELECT symbol, ts, round(rsi, 4) AS rsi2 FROM rws LEFT JOIN rsi USING (symbol, rn)",
    "adx": f"{ROWS}, {_ADX} SELECT symbol, ts, round(adx, 4) AS adx FROM rws LEFT JOIN adx USING (symbol, rn)",
    "ema_cross": f"{_CROSS} SELECT symbol, ts, bull_cross, bear_cross FROM c",
    "regime": f"{_ALL} SELECT symbol, ts, close AS price, round(sma200, 6) AS sma200, round(adx, 4) AS adx, regime FROM reg",
    "regime_latest": f"{_ALL} SELECT symbol, ts, close AS price, round(sma200, 6) AS sma200, round(adx, 4) AS adx, regime FROM reg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "regime_playbook_diff": f"""{_ALL} SELECT DISTINCT pb.regime, pb.bot, c.status, pb.desired FROM (VALUES {_PLAYS}) AS pb(regime, bot, desired) JOIN reg ON reg.regime = pb.regime
  JOIN (VALUES ('crypto_grid', 'active'), ('survivor_bot', 'active'), ('wheel_bot', 'paused'), ('trend_bot', 'active'), ('moon_bag', 'paused'), ('condor_bot', 'active'), ('event_watch', 'active')) AS c(bot, status) ON c.bot = pb.bot WHERE c.status <> pb.desired""",
    "market_open": f"""WITH {bars_sql('15 minutes')} SELECT symbol, ts, close FROM (SELECT *, ts - INTERVAL 5 HOUR AS l FROM bars)
  WHERE isodow(l) < 6 AND strftime(l, '%Y-%m-%d') NOT IN ('2024-01-01', '2024-01-15') AND year(l) = 2024 AND month(l) = 1 AND strftime(l, '%H:%M') >= '09:30' AND strftime(l, '%H:%M') < '16:00'""",
    "trend_signals": f"""{_CROSS}, {_USED}, a AS (SELECT *, CASE WHEN symbol = 'click' AND bear_cross THEN 'sell' WHEN symbol = 'view' AND bull_cross THEN 'buy_cover'
    WHEN symbol NOT IN ('click', 'view') AND symbol IN ('purchase', 'signup', 'error') AND trend AND adx > 30 AND bull_cross THEN 'buy' WHEN symbol NOT IN ('click', 'view') AND symbol IN ('purchase', 'signup', 'error') AND trend AND adx > 30 AND bear_cross THEN 'sell_short' END AS action FROM c, gate),
  b AS (SELECT *, CASE WHEN action = 'sell' THEN 10.0::DOUBLE WHEN action = 'buy_cover' THEN 5.0::DOUBLE WHEN action IS NOT NULL THEN trunc(100000.0::DOUBLE * 0.02 / nullif(close * 0.02, 0)) END AS qty FROM a)
  SELECT symbol, ts, close AS price, round(adx, 4) AS adx, action, qty FROM b WHERE action IS NOT NULL AND qty > 0""",
    "survivor_signals": f"""{ROWS}, {_RSI}, {_USED}, j AS (SELECT rws.*, rsi, trunc(100000.0::DOUBLE * 0.05 / nullif(close, 0)) AS n,
    CASE symbol WHEN 'click' THEN (close - 40.0) / 40.0 WHEN 'view' THEN (close - 60.0) / 60.0 END AS gain FROM rws LEFT JOIN rsi USING (symbol, rn)),
  a AS (SELECT *, CASE WHEN symbol IN ('click', 'view') THEN CASE WHEN rsi > 70 OR gain > 0.05 OR gain < -0.03 THEN 'sell' END WHEN survivor AND rsi < 30 AND (close > coalesce(sma200, 0) OR symbol = 'purchase') AND n > 0 THEN 'buy' END AS action FROM j, gate)
  SELECT symbol, ts, close AS price, round(rsi, 4) AS rsi, action, CASE WHEN action = 'buy' THEN CASE symbol WHEN 'purchase' THEN 'SCOUT PICK' ELSE 'CORE' END
    WHEN rsi > 70 THEN 'RSI Overbought (' || round_even(rsi, 0)::INTEGER || ')' WHEN gain > 0.05 THEN 'Take Profit (+5%)' ELSE 'Stop Loss (-3%)' END AS reason, CASE WHEN action = 'buy' THEN n WHEN symbol = 'click' THEN 10.0::DOUBLE ELSE -5.0::DOUBLE END AS qty FROM a WHERE action IS NOT NULL""",
    "breakout_signals": f"""WITH {bars_sql('1 hour')}, j AS (SELECT *, CASE WHEN row_number() OVER w > 20 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS entry_high,
    CASE WHEN row_number() OVER w > 20 THEN min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS exit_low, CASE WHEN symbol = 'click' THEN 10.0::DOUBLE ELSE 0.0 END AS q FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  a AS (SELECT *, CASE WHEN q = 0 AND close > entry_high AND NOT coalesce(100000.0 * 0.1 / nullif(close, 0) * close > 20000.0, false) THEN 'buy_breakout' WHEN q > 0 AND close < exit_low THEN 'sell_breakout' END AS action FROM j)
  SELECT symbol, ts, close AS price, entry_high, exit_low, action, round(CASE WHEN action = 'buy_breakout' THEN 100000.0::DOUBLE * 0.1 / nullif(close, 0) ELSE q END, 4) AS qty, CASE WHEN action = 'buy_breakout' THEN round(100000.0::DOUBLE * 0.1 / nullif(close, 0), 4) ELSE q END AS order_qty FROM a WHERE action IS NOT NULL""",
    "position_sizing": """WITH t AS (SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS price FROM events GROUP BY 1) SELECT symbol, price, trunc(100000.0::DOUBLE * 0.02 / nullif(price * 0.02, 0))::BIGINT AS trend_qty, trunc(100000.0::DOUBLE * 0.05 / nullif(price, 0))::BIGINT AS survivor_qty,
  round(100000.0::DOUBLE * 0.1 / nullif(price, 0), 4) AS breakout_qty, round(50.0::DOUBLE / nullif(price, 0), 4) AS grid_qty FROM t""",
    "grid_zones": f"SELECT event_id AS id, value AS price, {_ZONE} AS zone FROM events WHERE event_type = 'click'",
    "grid_signals": f"{_GRID}, l AS (SELECT *, lag(zone) OVER (ORDER BY rn) AS pz FROM z) SELECT id, zone, CASE WHEN zone < pz THEN 'grid_buy' ELSE 'grid_sell' END AS action, round(50.0::DOUBLE / price, 4) AS qty FROM l WHERE pz IS NOT NULL AND pz <> -1 AND zone <> pz",
    "grid_inventory": f"""{_GRID}, f(rn, zone, held, buys, sells, blocked) AS (SELECT 0::BIGINT, -1, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT z.rn, z.zone, CASE WHEN f.zone <> -1 AND z.zone < f.zone THEN f.held + 50.0 / z.price WHEN f.zone <> -1 AND z.zone > f.zone AND f.held >= 50.0 / z.price THEN f.held - 50.0 / z.price ELSE f.held END,
    f.buys + CASE WHEN f.zone <> -1 AND z.zone < f.zone THEN 1 ELSE 0 END, f.sells + CASE WHEN f.zone <> -1 AND z.zone > f.zone AND f.held >= 50.0 / z.price THEN 1 ELSE 0 END,
    f.blocked + CASE WHEN f.zone <> -1 AND z.zone > f.zone AND f.held < 50.0 / z.price THEN 1 ELSE 0 END FROM f JOIN z ON z.rn = f.rn + 1)
  SELECT 'click' AS symbol, zone, round(held, 4) AS held, buys, sells, blocked FROM f ORDER BY rn DESC LIMIT 1""",
}

#: The trend follower's bars, with those outside sessions and the crypto pair left out.
_SESSION = "isodow(l) < 6 AND strftime(l, '%Y-%m-%d') NOT IN ('2024-01-01', '2024-01-15') AND year(l) = 2024 AND month(l) = 1 AND strftime(l, '%H:%M') >= '09:30' AND strftime(l, '%H:%M') < '16:00'"
SQL["trend_open"] = f"SELECT * EXCLUDE (l) FROM (SELECT *, ts - INTERVAL 5 HOUR AS l FROM ({SQL['trend_signals'].replace(bars_sql('1 hour'), bars_sql('15 minutes'))})) WHERE {_SESSION} AND symbol <> 'error'"
