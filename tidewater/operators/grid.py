"""Price-grid signals and inventory over ordered ticks.

A tick without a price, or with a price of 0, at which no quantity can be bought, is skipped: the zone
before it stays in force.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

INVENTORY = "symbol string, zone int, held double, buys bigint, sells bigint, blocked bigint"


def zoned(ticks: DataFrame, bottom: float, top: float, levels: int) -> DataFrame:
    """The ticks that count, with their ``zone``."""
    rows = ticks.where("price is not null and price <> 0").select("symbol", "ts", "id", "price")
    return rows.withColumn("zone", rules.grid_zone(F.col("price"), bottom, top, levels))


def with_previous_zone(rows: DataFrame, before: DataFrame | None = None, bucket: str = "hour") -> DataFrame:
    """Adds ``prev``, the zone of the tick before: a lag inside each ``bucket`` of time, carried from bucket to bucket.

    No task holds a symbol's whole history, only a bucket's ticks or one row a bucket. ``before(symbol, zone)``
    holds the zones before the first tick (-1, unknown, where a symbol is missing).
    """
    cut = rows.withColumn("_b", F.date_trunc(bucket, "ts"))
    last = cut.groupBy("symbol", "_b").agg(F.max_by("zone", F.struct("ts", "id")).alias("_z"))
    carried = last.withColumn("_z", F.lag("_z").over(Window.partitionBy("symbol").orderBy("_b")))
    if before is not None:
        known = before.select("symbol", F.col("zone").alias("_known"))
        carried = carried.join(known, "symbol", "left").withColumn("_z", F.coalesce("_z", "_known")).drop("_known")
    inside = F.lag("zone").over(Window.partitionBy("symbol", "_b").orderBy("ts", "id"))
    out = cut.withColumn("_i", inside).join(carried, ["symbol", "_b"])
    return out.withColumn("prev", F.coalesce("_i", "_z", F.lit(-1))).drop("_i", "_z", "_b")


def _action(zone: Column, prev: Column) -> Column:
    return F.when(prev == -1, None).when(zone < prev, "grid_buy").when(zone > prev, "grid_sell")


def grid_signals(ticks: DataFrame, bottom: float, top: float, levels: int, budget: float = 50.0, before: DataFrame | None = None) -> DataFrame:
    """``(symbol, ts, id, price, zone, action, qty)``: a change of zone buys on the way down and sells on the way up.

    From zone -1, which also means unknown, nothing follows.
    """
    rows = with_previous_zone(zoned(ticks, bottom, top, levels), before).withColumn("action", _action(F.col("zone"), F.col("prev")))
    return rows.withColumn("qty", F.when(F.col("action").isNotNull(), rules.grid_quantity(F.col("price"), budget))).select("symbol", "ts", "id", "price", "zone", "action", "qty")


def fold_trades(trades: Iterable[tuple[str, float]], held: float = 0.0) -> Iterator[tuple[str, float]]:
    """``(what was done, inventory)`` over ``(action, qty)`` in order; a sell that lacks inventory is ``blocked``."""
    for action, qty in trades:
        if action == "grid_buy":
            held += qty
        elif held >= qty:
            held -= qty
        else:
            action = "blocked"
        yield action, held


def grid_inventory(ticks: DataFrame, bottom: float, top: float, levels: int, budget: float = 50.0, before: DataFrame | None = None) -> DataFrame:
    """``(symbol, zone, held, buys, sells, blocked)`` after all ticks, beginning with the state ``before`` of the same columns.

    A sell that lacks inventory is blocked, so that the inventory is a fold in order, not a running sum. Only the
    changes of zone are folded, from a sorted partition with one symbol's state at a time.
    """
    rows = zoned(ticks, bottom, top, levels)
    done = with_previous_zone(rows, before).withColumn("action", _action(F.col("zone"), F.col("prev")))
    trades = done.where("action is not null").select("symbol", "ts", "id", "action", rules.grid_quantity(F.col("price"), budget).alias("qty"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    last = rows.groupBy("symbol").agg(F.max_by("zone", F.struct("ts", "id")).alias("zone"))
    if before is None:
        begun = last.select("symbol", "zone", F.lit(0.0).alias("held"), *(F.lit(0).cast("bigint").alias(c) for c in ("buys", "sells", "blocked")))
    else:
        known = before.select("symbol", F.col("zone").alias("_zone"), "held", "buys", "sells", "blocked")
        begun = last.join(known, "symbol", "full").select("symbol", F.coalesce("zone", "_zone").alias("zone"), F.coalesce("held", F.lit(0.0)).alias("held"), zero("buys"), zero("sells"), zero("blocked"))
    # each symbol's state goes first, then its trades
    state = begun.select("symbol", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("id"), F.lit("state").alias("action"), F.col("held").alias("qty"))
    both = trades.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("id", F.col("id").cast("bigint")).unionAll(state)
    order = both.repartition("symbol").sortWithinPartitions("symbol", F.col("action") != "state", "ts", "id").select("symbol", "action", "qty")
    folded = order.mapInArrow(_fold_inventory, "symbol string, held double, buys bigint, sells bigint, blocked bigint")
    new = folded.select("symbol", F.col("held").alias("_held"), *(F.col(c).alias(f"_{c}") for c in ("buys", "sells", "blocked")))
    return begun.join(new, "symbol").select("symbol", "zone", F.col("_held").alias("held"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("buys", "sells", "blocked")))


def _fold_inventory(batches):
    """Arrow batches of ``(symbol, action, qty)``, a symbol's state first, to one row a symbol."""
    import pyarrow as pa

    symbol, held, counts, known = None, 0.0, {}, False

    def told():
        return pa.record_batch([pa.array([symbol], pa.string()), pa.array([held]), *(pa.array([counts[c]], pa.int64()) for c in ("grid_buy", "grid_sell", "blocked"))], names=["symbol", "held", "buys", "sells", "blocked"])

    for b in batches:
        symbols, actions, sizes = (c.to_pylist() for c in b.columns)
        at = 0
        while at < len(symbols):
            if actions[at] == "state":
                if known:
                    yield told()
                symbol, held, counts, known = symbols[at], sizes[at], dict.fromkeys(("grid_buy", "grid_sell", "blocked"), 0), True
                at += 1
                continue
            end = at
            while end < len(symbols) and actions[end] != "state":
                end += 1
            for action, held in fold_trades(zip(actions[at:end], sizes[at:end]), held):
                counts[action] += 1
            at = end
    if known:
        yield told()
