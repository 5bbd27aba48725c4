"""Option contract selection, pricing and management."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources import scans
from .ledger import allowed
from .lookups import nearest, prefix_join
from .signals import while_open

#: The least premium that is sold, and the most underlyings that the condor holds.
MIN_PREMIUM, MAX_POSITIONS = 0.10, 3
#: The legs in order of execution: name, type, side, distance from the price.
LEGS = (("put_long", "PUT", "BUY", -0.13), ("call_long", "CALL", "BUY", 0.13), ("put_short", "PUT", "SELL", -0.08), ("call_short", "CALL", "SELL", 0.08))


def wheel_strike(chain: DataFrame, spots: DataFrame, side: str, target: float = 0.05) -> DataFrame:
    """Per underlying the out-of-the-money contract whose distance is nearest to ``target``.

    Ties go to the earlier expiration, the lower strike, the smaller symbol; scores of 1 or more never win.
    """
    rows = chain.where(F.col("type") == side).join(spots, "underlying")
    rows = rows.where(F.col("strike") < F.col("spot") if side == "PUT" else F.col("strike") > F.col("spot"))
    score = F.abs(F.try_divide(F.abs(F.col("spot") - F.col("strike")), F.col("spot")) - target)
    rows = rows.withColumn("score", score).where("score < 1.0")
    best = F.min(F.struct("score", "expiration", "strike", "symbol")).alias("b")
    return rows.groupBy("underlying").agg(best).select("underlying", "b.symbol", "b.expiration", "b.strike", "b.score")


def condor_legs(chain: DataFrame, spots: DataFrame, legs=LEGS) -> DataFrame:
    """Nearest contract for each of four strikes; only underlyings that have all four, legs in order."""
    offsets = [(f"{side}", i, n, t, d) for i, (n, t, side, d) in enumerate(legs)]
    found = strike_ladder(chain, spots, offsets)
    whole = found.groupBy("underlying").agg(F.count("*").alias("n")).where(F.col("n") == len(legs)).select("underlying")
    return found.join(whole, "underlying").select("underlying", "leg_no", "leg", "side", "target", "symbol", "strike", "diff")


def strike_ladder(chain: DataFrame, spots: DataFrame, offsets) -> DataFrame:
    """Per underlying and offset ``(side, number, name, type, distance from the price)`` the contract of the nearest strike.

    Ties go to the earlier expiration, the lower strike, the smaller symbol. Strikes and targets are ordered together
    once, however many offsets there are.
    """
    spec = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(i).alias("leg_no"), F.lit(n).alias("leg"), F.lit(t).alias("type"), F.lit(d).alias("off")) for side, i, n, t, d in offsets))
    wanted = spots.select("underlying", "spot", F.explode(spec).alias("l")).select("underlying", "l.*", (F.col("spot") * (1 + F.col("l.off"))).alias("target"))
    found = nearest(chain, wanted, ["underlying", "type"], "strike", "target", ["expiration", "strike", "symbol"])
    return found.select("underlying", "leg_no", "leg", "side", "target", F.col("best.tie.symbol").alias("symbol"), F.col("best.value").alias("strike"), F.col("best.score").alias("diff"))


def price_legs(legs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Limit price per leg: ask to buy, bid to sell, a floor for bad quotes (and for missing ones)."""
    q = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid_price", "ask_price"), "ts").alias("q"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return legs.join(q, "symbol", "left").withColumn("limit_price", rules.leg_limit(F.col("side"), zero("q.bid_price"), zero("q.ask_price"))).drop("q")


def take_profit(positions: DataFrame, short_only: bool = True, share: float = 0.5) -> DataFrame:
    """Options to buy back because enough of the premium is kept."""
    rows = positions.where("asset_class = 'US_OPTION'").withColumn("capture", rules.capture(F.col("avg_entry_price"), F.col("current_price")))
    rows = rows.where(F.col("capture") >= share)
    rows = rows.where("qty < 0") if short_only else rows
    return rows.select("symbol", "capture", F.abs(F.col("qty").cast("bigint")).alias("close_qty"), (F.col("current_price") * 1.05).alias("fallback_limit"))


def close_orders(positions: DataFrame, quotes: DataFrame, share: float = 0.5, bump: float = 1.05) -> DataFrame:
    """Orders that buy options back: ``(symbol, owner, capture, close_qty, limit_price)``.

    The condor closes short legs at a bit above the latest ask; the wheel closes at the ask, or a bit above
    the estimate where the ask is 0 or there is none.
    """
    ask = scans.latest_quote(quotes, "ask").select("symbol", F.col("price").alias("_ask"))
    rows = positions.where("asset_class = 'US_OPTION'").withColumns({"owner": rules.owner(F.col("symbol"), F.col("asset_class")), "capture": rules.capture(F.col("avg_entry_price"), F.col("current_price"))})
    rows = rows.where((F.col("capture") >= share) & ((F.col("owner") == "wheel_bot") | (F.col("qty") < 0)))
    rows = rows.join(ask, "symbol", "left").withColumn("_ask", F.coalesce("_ask", F.lit(0.0)))
    limit = F.when(F.col("owner") == "wheel_bot", rules.close_limit(F.col("_ask"), F.col("current_price"), bump)).otherwise(F.col("_ask") * bump)
    return rows.select("symbol", "owner", "capture", F.abs(F.col("qty").cast("bigint")).alias("close_qty"), limit.alias("limit_price"))


def wheel_orders(strikes: DataFrame, quotes: DataFrame, side: str, power: float, budgets: DataFrame | None = None, least_premium: float = MIN_PREMIUM, now=None, calendar: DataFrame | None = None) -> DataFrame:
    """Contracts to sell: ``(underlying, symbol, limit_price)`` from ``strikes(underlying, symbol, strike, spot, ordinal)``.

    The limit is the latest bid, and a premium below ``least_premium`` is skipped. Puts need room in the bot's
    budget and buying power for a hundred shares, at the price and at the strike; it is spent in order. Nothing is
    sold if ``now`` (UTC) is in no session of ``calendar``, where one is given.
    """
    if calendar is not None:
        session = while_open(strikes.sparkSession.range(1).select(now.alias("ts")), calendar).select(F.lit(True).alias("_open"))
        strikes = strikes.join(F.broadcast(session), F.lit(True), "left_semi")
    bid = scans.latest_quote(quotes, "bid").select("symbol", F.col("price").alias("limit_price"))
    rows = strikes.join(bid, "symbol", "left").withColumn("limit_price", F.coalesce("limit_price", F.lit(0.0))).where(F.col("limit_price") >= least_premium)
    if side == "PUT":
        rows = rows.crossJoin(F.broadcast(allowed(budgets, "wheel_bot", strikes.sparkSession))).where("allowed")
        asked = rows.select(F.lit("wheel").alias("account"), "ordinal", (F.col("strike") * 100).alias("cost"), (F.col("spot") * 100).alias("need"))
        spent = spend_in_order(asked, power, need="need").where("accepted").select("ordinal")
        rows = rows.join(spent, "ordinal", "left_semi")
    return rows.select("underlying", "symbol", "limit_price")


def option_roots(positions: DataFrame) -> DataFrame:
    """Roots of held options that the condor owns, with their number of positions."""
    rows = positions.where("asset_class = 'US_OPTION'").withColumn("root", rules.option_root(F.col("symbol")))
    return rows.where(rules.owner(F.col("root"), F.lit("US_OPTION")) == "condor_bot").groupBy("root").agg(F.count("*").alias("n_positions"))


def last_options(watchlist: DataFrame, positions: DataFrame) -> DataFrame:
    """Per ticker its last held option, ``(ticker, <columns of positions>)``."""
    found = prefix_join(positions.where("asset_class = 'US_OPTION'"), watchlist.select("ticker").distinct(), "symbol", "ticker")
    return found.groupBy("ticker").agg(F.max_by(F.struct(*positions.columns), "ordinal").alias("_o")).select("ticker", "_o.*")


def wheel_closes(watchlist: DataFrame, positions: DataFrame, quotes: DataFrame, share: float = 0.5, bump: float = 1.05) -> DataFrame:
    """Orders that buy back the wheel's options: ``(ticker, symbol, capture, close_qty, limit_price)``.

    The wheel looks at one option a ticker, the last that it holds; others of the ticker wait until that one is gone.
    The limit is the latest ask, or a bit above the estimate where the ask is 0 or there is none.
    """
    ask = scans.latest_quote(quotes, "ask").select("symbol", F.col("price").alias("_ask"))
    rows = last_options(watchlist, positions).withColumn("capture", rules.capture(F.col("avg_entry_price"), F.col("current_price"))).where(F.col("capture") >= share)
    limit = rules.close_limit(F.coalesce("_ask", F.lit(0.0)), F.col("current_price"), bump)
    return rows.join(ask, "symbol", "left").select("ticker", "symbol", "capture", F.abs(F.col("qty").cast("bigint")).alias("close_qty"), limit.alias("limit_price"))


def active_options(watchlist: DataFrame, positions: DataFrame) -> DataFrame:
    """Per ticker the last held option whose symbol begins with it, and its stock quantity.

    ``watchlist(ticker)`` may be of any length; ``positions`` carry ``ordinal``, their order.
    """
    option = last_options(watchlist, positions).select("ticker", F.col("symbol").alias("option"))
    stock = positions.where("asset_class = 'US_EQUITY'").groupBy(F.col("symbol").alias("ticker")).agg(F.max_by("qty", "ordinal").alias("stock_qty"))
    out = watchlist.select("ticker").join(option, "ticker", "left").join(stock, "ticker", "left").withColumn("stock_qty", F.coalesce("stock_qty", F.lit(0.0)))
    return out.withColumn("side", F.when(F.col("option").isNull(), rules.wheel_side(F.col("stock_qty"))))


def spend_in_order(requests: DataFrame, power: float, key: str = "account", order: str = "ordinal", cost: str = "cost", need: str | None = None) -> DataFrame:
    """Accepts requests in order while the buying power lasts; a rejected one spends nothing.

    A request is accepted if the power left reaches its cost and, if ``need`` is given, that column, too.

    A running sum would let rejected requests spend, so requests are folded in order, with the power
    left of one ``key`` as the only state; accounts are folded side by side, a row at a time.
    """

    def fold(batches):
        import pyarrow as pa

        account = left = None
        begun = False
        for b in batches:
            accepted, lefts = [], []
            for k, c, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not begun or k != account:
                    account, left, begun = k, float(power), True
                ok = None if c is None else left >= c and left >= n
                if ok:
                    left -= c
                accepted.append(ok)
                lefts.append(left)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(accepted, pa.bool_()), pa.array(lefts, pa.float64())], names=[key, order, "accepted", "power_left"])

    rows = requests.select(key, F.col(order).cast("bigint").alias(order), F.col(cost).cast("double").alias(cost), F.coalesce(F.col(need or cost).cast("double"), F.lit(0.0)).alias("_need")).repartition(key).sortWithinPartitions(key, order, cost)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("accepted", "boolean"), ("power_left", "double"))]
    return rows.mapInArrow(fold, rows.select(F.nullif(F.col(key), F.col(key)).alias(key), F.nullif(F.col(order), F.col(order)).alias(order), *nothing).schema)


def first_condor(targets: DataFrame, active: DataFrame, prices: DataFrame, feasible: DataFrame, most: int = MAX_POSITIONS, budgets: DataFrame | None = None) -> DataFrame:
    """The one underlying to open: first in order, not active, priced, with all legs; none at ``most`` active roots or beyond the bot's budget."""
    room = active.agg((F.count_distinct("root") < most).alias("_room")).crossJoin(allowed(budgets, "condor_bot", targets.sparkSession)).select((F.col("_room") & F.col("allowed")).alias("_room"))
    rows = targets.join(active.select(F.col("root").alias("underlying")).distinct(), "underlying", "left_anti").join(prices.where("price <> 0"), "underlying").join(feasible.select("underlying").distinct(), "underlying", "left_semi")
    return rows.crossJoin(F.broadcast(room)).where("_room").drop("_room").orderBy("ordinal").limit(1)
