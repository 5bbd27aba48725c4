"""Edge cases of rules, ledger, options, grid, fleet, sources and sinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import rules
from tidewater.operators import fleet, grid, ledger, options, signals
from tidewater.sources import documents, scans, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(("adx", "price", "sma", "want"), [(30, 5, None, "BEAR_TREND"), (None, 5, 4, "CHOP"), (25, 5, 4, "CHOP"), (30, 5, 5, "BEAR_TREND"), (30, 6, 5, "BULL_TREND")])
def test_regime(spark, adx, price, sma, want):
    assert one(spark, rules.regime(lit(adx), lit(price), lit(sma))) == (want,)


@pytest.mark.parametrize(("symbol", "kind", "report", "budget"), [("F240119P1", "US_OPTION", "wheel_bot", "wheel_bot"), ("FNGU240119C1", "US_OPTION", "wheel_bot", "wheel_bot"), ("XYZ1", "US_OPTION", "condor_bot", "condor_bot"), ("SPXL", "US_EQUITY", "trend_bot", "survivor_bot"), ("BTC/USD", "CRYPTO", "crypto_grid", "crypto_grid"), ("DIS", "US_EQUITY", "wheel_bot", "wheel_bot")])
def test_owner(spark, symbol, kind, report, budget):
    s, k = F.lit(symbol), F.lit(kind)
    assert one(spark, rules.owner(s, k, rules.REPORT_OWNERS), rules.owner(s, k)) == (report, budget)


def test_zero_denominators_and_sizes(spark):
    got = one(spark, rules.gain(lit(1), lit(0)), rules.capture(lit(0), lit(1)), rules.trend_shares(lit(100), lit(0)), rules.whole_shares(lit(27), lit(10)), rules.option_root(F.lit("ABC")), rules.option_root(F.lit("TSLA24P")))
    assert got == (None, None, None, 2, "ABC", "TSLA")


def test_budget_and_prices(spark):
    got = one(spark, rules.within_budget(lit(100), lit(None), lit(1e9)), rules.within_budget(lit(100), lit(0.5), lit(50)), rules.leg_limit(F.lit("BUY"), lit(1), lit(0.0)), rules.close_limit(lit(0), lit(2)), rules.survivor_exit(lit(71.0), lit(0)), rules.survivor_exit(lit(None), lit(-0.04)))
    assert got == (True, False, 0.05, 2.1, "RSI Overbought (71)", "Stop Loss (-3%)")


TICKS = [20, 85, 40, 5, 30, 60, 20, 70, 90]


def grid_ticks(spark, prices, symbol="X", first=0):
    rows = [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), first + i, p) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, id bigint, price double")


def grid_by_hand(prices, bottom=10.0, top=85.0, levels=6, budget=50.0):
    """The state machine a tick at a time: the zone, what was done, the inventory."""
    zone, held, out = -1, 0.0, []
    for p in prices:
        if not p:
            continue
        now = -1 if p < bottom else levels if p > top else int((p - bottom) / ((top - bottom) / levels))
        done = None
        if now != zone and zone != -1:
            qty = budget / p
            done = "grid_buy" if now < zone else "grid_sell" if held >= qty else "blocked"
            held += qty if done == "grid_buy" else -qty if done == "grid_sell" else 0.0
        zone = now
        out.append((zone, done, held))
    return out


def test_grid_golden(spark):
    ticks = grid_ticks(spark, [*map(float, TICKS), None])
    by_hand = grid_by_hand(TICKS)
    assert [x[:2] for x in by_hand] == [(0, None), (6, "blocked"), (2, "grid_buy"), (-1, "grid_buy"), (1, None), (4, "grid_sell"), (0, "grid_buy"), (4, "grid_sell"), (6, "grid_sell")]
    signals_ = grid.grid_signals(ticks, 10, 85, 6).orderBy("id").collect()
    assert [r["zone"] for r in signals_] == [z for z, _, _ in by_hand]
    assert [r["action"] for r in signals_] == [a and a.replace("blocked", "grid_sell") for _, a, _ in by_hand]
    end = grid.grid_inventory(ticks, 10, 85, 6).first()
    assert (end["zone"], end["buys"], end["sells"], end["blocked"]) == (6, 3, 3, 1)
    assert grid.grid_inventory(ticks.where("false"), 10, 85, 6).count() == 0


def test_grid_price_of_zero_is_skipped(spark):
    prices = [50.0, 0.0, 50.0, 30.0, 0.0, 60.0, 0.0]
    ticks = grid_ticks(spark, prices)
    got = [(r["price"], r["action"]) for r in grid.grid_signals(ticks, 10, 85, 6).orderBy("id").collect()]
    assert got == [(50.0, None), (50.0, None), (30.0, "grid_buy"), (60.0, "grid_sell")]
    end = grid.grid_inventory(ticks, 10, 85, 6).first()
    assert (end["zone"], end["buys"], end["sells"], end["blocked"]) == (4, 1, 1, 0) and end["held"] == pytest.approx(50 / 30 - 50 / 60)
    assert grid.grid_inventory(grid_ticks(spark, [0.0, None]), 10, 85, 6).count() == 0


def test_grid_in_parts_is_the_grid_of_all(spark):
    rng = random.Random(5)
    prices = {s: [rng.choice([0.0, None, *(rng.uniform(1, 100) for _ in range(8))]) for _ in range(300)] for s in "AB"}
    ticks = grid_ticks(spark, prices["A"], "A").unionAll(grid_ticks(spark, prices["B"], "B", 1000))
    want = {s: grid_by_hand(p) for s, p in prices.items()}
    check = {s: (w[-1][0], *(sum(x[1] == a for x in w) for a in ("grid_buy", "grid_sell", "blocked")), w[-1][2]) for s, w in want.items()}
    whole = grid.grid_inventory(ticks, 10, 85, 6)
    state = None
    for part in ("id % 1000 < 100", "id % 1000 between 100 and 104 and symbol = 'A'", "(id % 1000 between 100 and 104 and symbol = 'B') or id % 1000 > 104"):
        rows = grid.grid_inventory(ticks.where(part), 10, 85, 6, before=state).collect()
        state = spark.createDataFrame(rows, grid.INVENTORY)
    for got in (whole, state):
        for r in got.collect():
            assert (r["zone"], r["buys"], r["sells"], r["blocked"]) == check[r["symbol"]][:4] and r["held"] == pytest.approx(check[r["symbol"]][4])
    assert {r["symbol"] for r in whole.collect()} == {"A", "B"}


def test_realized_pnl_edges(spark):
    t = spark.createDataFrame([("trades", "BUY", 10.0, 2.0), ("trades", "sell_short", 12.0, 3.0), ("condor_trades", "open_condor", 5.0, None), ("wheel_trades", "sell_put", 5.0, None), ("x", None, 1.0, 1.0)], "bot_type string, action string, price double, qty double")
    got = {r["bot"]: r["realized_pl"] for r in ledger.realized_pnl(t).collect()}
    assert got == {"trend_bot": 0.0, "condor_bot": 0.0, "wheel_bot": 0.0}  # of two logs of one bot the last by name counts
    got = {r["bot"]: r["realized_pl"] for r in ledger.realized_pnl(t.where("bot_type <> 'x'")).collect()}
    assert got["trend_bot"] == 36 - 10 * 3
    assert ledger.realized_pnl(t.where("false")).count() == 0


def test_strike_ties_and_scores(spark):
    rows = [("B2", "U", "PUT", dt.date(2024, 2, 1), 95.0, "active"), ("B1", "U", "PUT", dt.date(2024, 2, 1), 95.0, "active"), ("B3", "U", "PUT", dt.date(2024, 2, 1), 100.0, "active")]
    chain = spark.createDataFrame(rows, schemas.CONTRACTS)
    spots = spark.createDataFrame([("U", 100.0)], "underlying string, spot double")
    assert options.wheel_strike(chain, spots, "PUT").first()["symbol"] == "B1"
    far = spark.createDataFrame([("U", 1000.0)], "underlying string, spot double")
    assert options.wheel_strike(chain, far, "PUT", target=-0.2).count() == 0
    assert options.wheel_strike(chain, spots, "CALL").count() == 0
    assert options.condor_legs(chain, spots).count() == 0
    inside = scans.option_chain(chain, F.lit("2024-01-07").cast("date")).count()
    assert inside == 3 and scans.option_chain(chain, F.lit("2024-01-08").cast("date")).count() == 0


def test_spending_in_order(spark):
    rows = [("a", i, c) for i, c in enumerate([60.0, 50.0, 30.0, 20.0, 5.0])]
    got = options.spend_in_order(spark.createDataFrame(rows, "account string, ordinal bigint, cost double"), 100.0).orderBy("ordinal").collect()
    assert [r["accepted"] for r in got] == [True, False, True, False, True]


def test_spending_of_a_long_account_is_one_row_at_a_time(spark):
    requests = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("account"), (30_000 - F.col("id")).alias("ordinal"), (F.col("id") * 7919 % 101).cast("double").alias("cost"))
    requests = requests.unionAll(spark.createDataFrame([("a", 0, None)], "account string, ordinal bigint, cost double"))
    done = options.spend_in_order(requests, 5000.0)
    assert "collect_list" not in done._jdf.queryExecution().toString()
    left, want = {"a": 5000.0, "b": 5000.0}, []
    for r in sorted(requests.collect(), key=lambda r: r["ordinal"]):
        ok = None if r["cost"] is None else left[r["account"]] >= r["cost"]
        left[r["account"]] -= r["cost"] if ok else 0
        want.append((r["account"], r["ordinal"], ok, left[r["account"]]))
    assert [tuple(r) for r in done.orderBy("ordinal").collect()] == want


def test_wheel_guards(spark):
    strikes = spark.createDataFrame([(f"U{i}", f"C{i}", 90.0, 100.0, i) for i in range(5)], "underlying string, symbol string, strike double, spot double, ordinal bigint")
    quotes = spark.createDataFrame([("C0", dt.datetime(2024, 1, 1), 0.05, 0.2), ("C0", dt.datetime(2024, 1, 2), 0.3, 0.2), ("C1", dt.datetime(2024, 1, 1), 0.09, 0.2), ("C2", dt.datetime(2024, 1, 1), 0.1, 0.2), ("C3", dt.datetime(2024, 1, 1), 0.5, 0.6)], schemas.QUOTES)
    sold = lambda side, power, budgets=None: sorted(r["symbol"] for r in options.wheel_orders(strikes, quotes, side, power, budgets).collect())
    assert sold("CALL", 0.0) == ["C0", "C2", "C3"]  # C1 pays too little, C4 has no quote
    assert sold("PUT", 19_000.0) == ["C0", "C2"]
    assert sold("PUT", 18_999.0) == ["C0"]  # 9,999 are left, less than a hundred shares cost
    budgets = lambda ok: spark.createDataFrame([("wheel_bot", ok), ("trend_bot", True)], "bot string, allowed boolean")
    assert sold("PUT", 1e9, budgets(False)) == [] and sold("CALL", 0.0, budgets(False)) == ["C0", "C2", "C3"]
    assert sold("PUT", 1e9, budgets(True)) == ["C0", "C2", "C3"]


def test_closing_limits(spark):
    rows = [("F1", "US_OPTION", -2.0, 1.0, 0.4), ("PLTR1", "US_OPTION", 1.0, 1.0, 0.5), ("X1", "US_OPTION", -1.0, 1.0, 0.1), ("X2", "US_OPTION", 1.0, 1.0, 0.1), ("X3", "US_OPTION", -1.0, 0.0, 0.1)]
    held = spark.createDataFrame(rows, "symbol string, asset_class string, qty double, avg_entry_price double, current_price double")
    quotes = spark.createDataFrame([("F1", dt.datetime(2024, 1, 1), 0.3, 0.45), ("PLTR1", dt.datetime(2024, 1, 1), 0.0, 0.0), ("X1", dt.datetime(2024, 1, 1), 0.1, 0.2)], schemas.QUOTES)
    got = {r["symbol"]: (r["close_qty"], round(r["limit_price"], 4)) for r in options.close_orders(held, quotes).collect()}
    assert got == {"F1": (2, 0.45), "PLTR1": (1, 0.525), "X1": (1, 0.21)}


def test_budgets_gate_entries(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    close = [100.0 - i for i in range(40)]
    bars = spark.createDataFrame([(s, day(i), c, c, c, c) for s in ("A", "B", "BTC/USD") for i, c in enumerate(close)], schemas.BARS)
    account = spark.createDataFrame([(1e6, 1e6, 1e6, 1e6)], schemas.ACCOUNT)
    held = spark.createDataFrame([("B", "long", 5.0, 10.0)], "symbol string, side string, qty double, avg_entry_price double")
    scouted = spark.createDataFrame([("A",), ("BTC/USD",)], "symbol string")
    def actions(ok):
        budgets = spark.createDataFrame([("survivor_bot", ok)], "bot string, allowed boolean")
        return {r["symbol"]: (r["action"], r["reason"]) for r in signals.survivor_signals(bars, held, account, scouted, budgets).collect()}
    assert actions(True) == {"A": ("buy", "SCOUT PICK"), "B": ("sell", "Take Profit (+5%)")}  # crypto is never scanned
    assert actions(False) == {"A": (None, None), "B": ("sell", "Take Profit (+5%)")}
    trend = signals.trend_signals(bars, held, account, scouted, every=True)
    assert {r["symbol"] for r in trend.collect()} == {"A", "B"}
    room = lambda **o: options.first_condor(spark.createDataFrame([("U", 1)], "underlying string, ordinal int"), spark.createDataFrame([("X",), ("Y",)], "root string"), spark.createDataFrame([("U", 5.0)], "underlying string, price double"), spark.createDataFrame([("U",)], "underlying string"), **o).count()
    assert room() == 1 and room(most=2) == 0
    assert room(budgets=spark.createDataFrame([("condor_bot", False)], "bot string, allowed boolean")) == 0


def test_sessions(spark):
    calendar = spark.createDataFrame([(dt.date(2024, 1, 2), "09:30", "16:00"), (dt.date(2024, 7, 2), "09:30", "13:00")], "day date, opens string, closes string")
    times = [dt.datetime(2024, 1, 2, 14, 29), dt.datetime(2024, 1, 2, 14, 30), dt.datetime(2024, 1, 2, 20, 59), dt.datetime(2024, 1, 2, 21, 0), dt.datetime(2024, 1, 3, 15, 0), dt.datetime(2024, 7, 2, 13, 30), dt.datetime(2024, 7, 2, 17, 0), None]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts timestamp_ntz, day int")
    assert [r["day"] for r in signals.while_open(rows, calendar).orderBy("ts").collect()] == [1, 2, 5]


def test_streams_follow_the_poll_periods():
    from tidewater.streaming import jobs

    class Writer:
        def trigger(self, **how):
            return how

    assert jobs.polled(Writer(), "wheel") == {"processingTime": "900 seconds"} and jobs.polled(Writer(), "wheel", once=True) == {"availableNow": True}
    assert set(jobs.TRIGGERS) == {"grid", "trend", "survivor", "report", "wheel", "condor", "breakout"}


def test_fleet(spark):
    bots = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "paused"), ("d", "active"), ("e", "paused")], "bot string, status string")
    rows = [("b", "online"), ("b", "errored"), ("c", "online"), ("d", "stopped"), ("d", "online"), ("supervisor", "online")]
    procs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, status string, ordinal int").orderBy("status")
    got = {r["bot"]: r["command"] for r in fleet.reconcile(bots, procs).collect()}
    assert got == {"a": "start", "b": "restart", "c": "stop", "d": None, "e": None}
    assert {r["bot"] for r in fleet.emergency_stop(procs).collect()} == {"b", "c", "d"}


def test_one_bar_sector_is_not_hot(spark):
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0)], schemas.BARS)
    assert signals.sector_moves(bars).first()["hot"] is False


def test_documents_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"targets": ["A", "B"],\n "updated": "now"}')
    read = documents.read_json(spark, str(tmp_path / "t.json"), schemas.TARGETS)
    assert {r["symbol"] for r in documents.targets(read).collect()} == {"A", "B"}
    assert {r["symbol"] for r in documents.targets(read.where("false")).collect()} == set(documents.DEFAULT_TARGETS)
    rows = spark.createDataFrame([("b1", 1.5, "x", None)], "bot string, v double, s string, n double")
    assert sinks.line_protocol(rows, "m", ["bot"], ["v", "s", "n"]).first()["line"] == 'm,bot=b1 v=1.5,s="x"'
    sinks.write_lines(rows, str(tmp_path / "lines"), "m", ["bot"], ["v"])
    assert spark.read.text(str(tmp_path / "lines")).first()["value"] == "m,bot=b1 v=1.5"
    trades = spark.createDataFrame([("2024-01-01", "A", 1), ("2024-01-03", "B", 2), ("2024-01-02", "C", 3)], "time string, symbol string, n int")
    sinks.export_csv(trades, str(tmp_path / "csv"))
    assert [r["symbol"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["B", "C", "A"]
    sinks.write_json(sinks.target_document(trades, F.lit("d")), str(tmp_path / "doc"))
    assert documents.read_json(spark, str(tmp_path / "doc"), schemas.TARGETS).first()["targets"] == ["A", "B", "C"]
    assert sinks.known_first(trades.withColumn("extra", F.lit(1)), ("symbol", "time")).columns == ["symbol", "time", "n", "extra"]


def test_history_takes_latest_or_earliest(spark):
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, d), 1.0, 1.0, 1.0, float(d)) for d in range(1, 6)], schemas.BARS)
    assert sorted(r["close"] for r in scans.history(bars, limit=2).collect()) == [4, 5]
    assert sorted(r["close"] for r in scans.history(bars, limit=2, take="earliest").collect()) == [1, 2]


def test_prefixes_meet_by_equality(spark):
    from tidewater.operators.lookups import prefix_join

    rows = spark.createDataFrame([(1, "FNGU24"), (2, "F24"), (3, "XYZ"), (4, None), (5, ""), (6, "FN")], "k int, symbol string")
    listed = spark.createDataFrame([("F",), ("FNGU",), ("FN",), ("",), (None,), ("FNGU240000",)], "ticker string")
    out = prefix_join(rows, listed, "symbol", "ticker")
    assert sorted((r["k"], r["ticker"]) for r in out.collect()) == [(1, "F"), (1, "FN"), (1, "FNGU"), (2, "F"), (6, "F"), (6, "FN")]
    long = spark.range(1_000_000).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("ticker"))
    held = spark.createDataFrame([("T0000007PUT", "US_OPTION", 1), ("T0999999", "US_EQUITY", 2), ("T9", "US_OPTION", 3), ("Z", "CRYPTO", 4)], "symbol string, asset_class string, ordinal int")
    out = ledger.attribute_listed(held, long.select("ticker", F.lit("wheel_bot").alias("bot"), F.monotonically_increasing_id().alias("ordinal")))
    assert {r["ordinal"]: r["owner"] for r in out.collect()} == {1: "wheel_bot", 2: "wheel_bot", 3: "condor_bot", 4: "crypto_grid"}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_owners_of_lists_equal_the_rule(spark):
    symbols = ["TQQQ", "DIS", "F", "FOO", "NVDA", "DIS24P", "F24P", "TSLA24P", "ZZ24P", "BTCUSD", "COIN", "PLTR1"]
    rows = spark.createDataFrame([(s, k) for s in symbols for k in ("CRYPTO", "US_OPTION", "US_EQUITY")], "symbol string, asset_class string")
    out = ledger.attribute_listed(rows, ledger.listed_owners(spark)).withColumn("want", rules.owner(F.col("symbol"), F.col("asset_class")))
    assert out.count() == len(symbols) * 3 and not out.where("owner <> want").collect()


def test_nearest_values(spark):
    import random

    from tidewater.operators.lookups import nearest

    rng = random.Random(2)
    values = [(rng.choice("ab"), rng.choice([1.0, 2.0, 2.5, 4.0, 7.0]), rng.randrange(9)) for _ in range(40)] + [("a", None, 0), ("c", 1.0, 1)]
    targets = [(rng.choice("abd"), rng.choice([0.0, 1.0, 1.5, 2.25, 3.0, 5.5, 9.0]), i) for i in range(30)] + [("a", None, 99)]
    got = nearest(spark.createDataFrame(values, "k string, v double, n int"), spark.createDataFrame(targets, "k string, t double, i int"), ["k"], "v", "t", ["n"])
    want = {}
    for k, t, i in targets:
        near = [(abs(v - t), n, v) for kk, v, n in values if kk == k and v is not None and t is not None]
        if near:
            want[i] = min(near)
    assert {r["i"]: (r["best"]["score"], r["best"]["tie"]["n"], r["best"]["value"]) for r in got.collect()} == want


def test_the_wheel_looks_at_its_last_option(spark):
    rows = [("F1", "US_OPTION", -2.0, 1.0, 0.4, 1), ("F2", "US_OPTION", -3.0, 1.0, 0.3, 2), ("F3", "US_OPTION", -1.0, 0.0, 0.3, 0), ("DIS1", "US_OPTION", -1.0, 1.0, 0.9, 3), ("X1", "US_OPTION", -1.0, 1.0, 0.1, 4)]
    held = spark.createDataFrame(rows, "symbol string, asset_class string, qty double, avg_entry_price double, current_price double, ordinal int")
    watch = spark.createDataFrame([("F",), ("DIS",), ("F",)], "ticker string")
    got = options.wheel_closes(watch, held, spark.createDataFrame([], schemas.QUOTES)).collect()
    assert [(r["ticker"], r["symbol"], r["close_qty"], round(r["limit_price"], 4)) for r in got] == [("F", "F2", 3, 0.315)]


def test_no_pass_outside_sessions(spark):
    calendar = spark.createDataFrame([(dt.date(2024, 1, 2), "09:30", "16:00")], "day date, opens string, closes string")
    bars = spark.createDataFrame([(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 100.0 - i, 100.0 - i, 100.0 - i, 100.0 - i) for s in "AB" for i in range(48)], schemas.BARS)
    account = spark.createDataFrame([(1e6, 1e6, 1e6, 1e6)], schemas.ACCOUNT)
    scouted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    held = spark.createDataFrame([], "symbol string, side string, qty double, avg_entry_price double")
    found = lambda every: signals.survivor_signals(bars, held, account, scouted, every=every, calendar=calendar)
    assert found(False).count() == 0  # the last bars are at 23:00
    assert {r["ts"].hour for r in found(True).collect()} == {15, 16, 17, 18, 19, 20}
    strikes = spark.createDataFrame([("U", "C", 90.0, 100.0, 0)], "underlying string, symbol string, strike double, spot double, ordinal bigint")
    quotes = spark.createDataFrame([("C", dt.datetime(2024, 1, 1), 0.5, 0.6)], schemas.QUOTES)
    sold = lambda now: options.wheel_orders(strikes, quotes, "PUT", 1e6, now=F.lit(now).cast("timestamp_ntz"), calendar=calendar).count()
    assert (sold("2024-01-02 15:00:00"), sold("2024-01-02 22:00:00"), sold("2024-01-03 15:00:00")) == (1, 0, 0)


def test_dated_logs_are_pruned(spark, tmp_path):
    from tidewater.sources import sinks

    days = spark.range(400).select(F.timestamp_seconds(F.col("id") * 86400 + 3600).alias("time"), F.col("id").alias("n"))
    sinks.write_dated(days, str(tmp_path))
    now = F.lit("1971-02-01 00:00:00").cast("timestamp")
    out = scans.dated_scan(spark.read.parquet(str(tmp_path)), now, 7)
    want = scans.recent(days, now, 7)
    assert sorted(r["n"] for r in out.collect()) == sorted(r["n"] for r in want.collect()) and out.columns == days.columns
    plan = out._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(period" in text
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numFiles").value() <= 11  # of 400


def test_lines_can_be_parsed(spark):
    from tidewater.sources import sinks

    rows = spark.createDataFrame([("a b,c=d", 'say "hi" \\ now', 1), (None, None, 2)], "tag string, text string, n int")
    got = [r["line"] for r in sinks.line_protocol(rows, "m", ["tag"], ["text", "n"]).collect()]
    assert got == [r'm,tag=a\ b\,c\=d text="say \"hi\" \\ now",n=1', "m n=2"]
