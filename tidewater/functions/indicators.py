"""Technical indicators as scans over chunks of a symbol's history.

Rows of a symbol are numbered by time and dealt in chunks of consecutive rows, each packed into one
row of arrays; a task holds one chunk and the few rows before it that windows reach back to. Windows
of any length take constant time a row: sums and extremes inside blocks as long as the window, from
the front and from the back, two of which make up every window. Recurrences (exponential and Wilder
averages) are affine maps, s -> a s + b, a row; the maps of a chunk compose to one, those of all
chunks are folded in order with the state as all that is kept, and every chunk then begins with the
state before it. So an average of any length is exact, and what a task holds does not grow with it.
A scan that builds on another one (ADX on directional moves) is one more fold.

A step is ``function(chunk)`` with what it needs to know as attributes; it may use the columns of
steps before it. Missing values are null, never NaN. A missing price counts nothing: weights of the
others are as if it were not there. Rows without a symbol or a time have no place in a history and
are left out. Columns of the bars keep their names and values, but for those that a step adds and
``rn``, the row number, which replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024


def number_bars(bars: DataFrame, bucket: str = "month") -> DataFrame:
    """Adds ``rn``, the row number from 1 of each symbol by time: counted per period, then shifted."""
    cut = bars.where("symbol is not null and ts is not null").withColumn("_bucket", F.date_trunc(bucket, "ts"))
    months = cut.groupBy("symbol", "_bucket").agg(F.count("*").alias("c"))
    # a symbol has a row a period here: running sums over a short array
    listed = months.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_bucket", "c"))).alias("_m"))
    begun = F.transform("_m", lambda m, i: F.struct(m["_bucket"].alias("_bucket"), F.aggregate(F.slice("_m", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["c"]).alias("_before")))
    before = listed.select("symbol", F.inline(begun))
    local = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy("ts"))
    return cut.withColumn("rn", local).join(before.hint("shuffle_hash"), ["symbol", "_bucket"]).withColumn("rn", F.col("_before") + F.col("rn")).drop("_bucket", "_before")


class Chunk:
    """Rows of a chunk in order, with those before it that windows need: ``rn`` and columns as arrays, NaN where a value is missing."""

    def __init__(self, rn: np.ndarray, columns: dict[str, np.ndarray], begin: int, states: np.ndarray | None, known: int):
        self.rn, self.columns, self.begin, self.states, self.known = rn, columns, begin, states, known
        self.scans: list[tuple[np.ndarray, np.ndarray]] = []

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __setitem__(self, name: str, values: np.ndarray) -> None:
        self.columns[name] = values

    def where(self, held: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.where(held, values, np.nan)

    def scan(self, a: np.ndarray | float, b: np.ndarray, level: int = 1) -> np.ndarray:
        """States of s -> a s + b from the history's first row on, where s was 0. ``level``: 1, or one more than that of the scans that ``b`` comes from.

        Where the state before the chunk is not known yet, the maps are noted and NaN is given.
        """
        a = np.broadcast_to(np.asarray(a, float), b.shape)
        number = len(self.scans)
        self.scans.append((a, b))
        out = np.full(len(b), np.nan)
        if level <= self.known:
            p, q = composed(a[self.begin :], b[self.begin :])
            out[self.begin :] = q if self.states is None else p * self.states[number] + q
        return out


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps up to each row as one, by doubling: those of twice as many rows with every pass."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def sliding(op: np.ufunc, x: np.ndarray, n: int, nothing: float) -> np.ndarray:
    """``op`` over the last ``n`` values up to each place (fewer at the front), in constant time each; NaN counts as ``nothing``."""
    blocks = -(-len(x) // n)
    padded = np.full(blocks * n, nothing)
    padded[: len(x)] = np.where(np.isnan(x), nothing, x)
    padded = padded.reshape(blocks, n)
    front = op.accumulate(padded, axis=1).ravel()[: len(x)]
    if n == 1 or not len(x):
        return front
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    out, at = front.copy(), np.arange(n, len(x))
    at = at[(at + 1) % n != 0]  # else the window is one whole block
    out[at] = op(back[at - n + 1], front[at])
    return out


def previous(x: np.ndarray, n: int = 1) -> np.ndarray:
    """The value ``n`` rows before."""
    out = np.full(len(x), np.nan)
    out[n:] = x[: len(x) - n] if n else x
    return out


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, NaN where y is 0."""
    return np.divide(x, y, out=np.full(len(x), np.nan), where=(y != 0) & ~np.isnan(y))


Step = Callable[[Chunk], None]


def _step(adds: Iterable[str], reads: Iterable[str], reach: int = 0, level: int = 0, flags: bool = False):
    """Marks a step: the columns it adds and reads, the rows before a row that it looks at, the number of scans on top of each other."""

    def mark(step: Step) -> Step:
        step.adds, step.reads, step.reach, step.level, step.flags = tuple(adds), tuple(reads), reach, level, flags
        return step

    return mark


def _run(steps: tuple[Step, ...], known: int, first_rn: int, rn: np.ndarray, columns: dict[str, np.ndarray], chunk: int, halo: int, states: np.ndarray | None) -> tuple[Chunk, int]:
    """The steps over one chunk, whose rows are in order; the chunk and its first own row."""
    own = int(np.searchsorted(rn, first_rn))
    begin = own - halo + _lead(steps) if first_rn > 1 else 0
    c = Chunk(rn, columns, begin, None if states is None or first_rn == 1 else np.asarray(states, float), known)
    with np.errstate(all="ignore"):
        for s in steps:
            s(c)
    return c, own


def _lead(steps: tuple[Step, ...]) -> int:
    """Rows that one pass of windows reaches back."""
    return sum(s.reach for s in steps)


def enrich(bars: DataFrame, *steps: Step, chunk: int = CHUNK) -> DataFrame:
    """Applies indicator steps to bars ``(symbol, ts, ...)``; adds their columns and ``rn``.

    ``chunk`` is the number of rows of a chunk, more only where windows reach further back.
    """
    levels = max((s.level for s in steps), default=0)
    # windows lead to scans, and windows over these may lead back as far again
    halo = _lead(steps) * (2 if levels else 1)
    size = max(chunk, halo, 1)
    adds = list(dict.fromkeys(n for s in steps for n in s.adds))
    flags = {n for s in steps if s.flags for n in s.adds}
    reads = list(dict.fromkeys(c for s in steps for c in s.reads if c in bars.columns))
    packed = _packed(bars, reads, size, halo)
    numbers = lambda c: F.transform("_rows", lambda r: r["_bar"][c].cast("double"))
    at = [F.col("_n"), *map(numbers, reads)]
    states, held = F.lit(None).cast("array<double>"), packed
    for known in range(levels):
        # each pass folds the scans of the levels before once more, so only the last one's states are needed
        maps = held.select("_symbol", "_chunk", _maps(steps, known, size, halo, reads)(F.col("_chunk"), states, *at).alias("_maps"))
        carried = _folded(maps, bars.schema["symbol"].dataType.simpleString())
        held = packed.join(carried.hint("shuffle_hash"), ["_symbol", "_chunk"], "left")
        states = F.col("_states")
    kinds = ", ".join(f"`{n}`: array<{'boolean' if n in flags else 'double'}>" for n in adds)
    done = held.withColumn("_new", _columns(steps, levels, size, halo, reads, adds, flags, kinds)(F.col("_chunk"), states, *at)) if adds else held
    rows = done.select(F.explode(F.arrays_zip("_rows", *(F.col(f"_new.`{n}`").alias(f"_{k}") for k, n in enumerate(adds)))).alias("_z")).where("_z._rows._own")
    kept = [F.col(f"_z._rows._bar.`{c}`").alias(c) for c in bars.columns if c not in (*adds, "rn")]
    return rows.select(*kept, F.col("_z._rows.rn").alias("rn"), *(F.col(f"_z._{k}").alias(n) for k, n in enumerate(adds)))


def _packed(bars: DataFrame, reads: list[str], size: int, halo: int) -> DataFrame:
    """``(_symbol, _chunk, _rows, _n)``: a row a chunk, with the last ``halo`` rows of the chunk before; ``_n``: row numbers as in ``_rows``."""
    plain = bars.select("symbol", "ts", F.struct(*bars.columns).alias("_bar"))
    own = F.floor((F.col("rn") - 1) / size)
    place = F.col("rn") - 1 - own * size
    where = F.struct(own.alias("c"), F.lit(True).alias("o"))
    both = F.array(where, F.struct((own + 1).alias("c"), F.lit(False).alias("o")))
    rows = number_bars(plain).withColumn("_w", F.explode(F.when(place >= size - halo, both).otherwise(F.array(where))))
    held = F.struct("rn", F.col("_w.o").alias("_own"), "_bar")
    packed = rows.groupBy(F.col("symbol").alias("_symbol"), F.col("_w.c").alias("_chunk")).agg(F.collect_list(held).alias("_rows"))
    # a halo alone is no chunk
    return packed.where(F.exists("_rows", lambda r: r["_own"])).withColumn("_n", F.transform("_rows", lambda r: r["rn"]))


def _ordered(rn, values, reads):
    order = np.argsort(rn, kind="stable")
    return order, np.asarray(rn)[order], {c: np.array(v, float)[order] for c, v in zip(reads, values)}


def _maps(steps, known, size, halo, reads):
    """pandas UDF: the chunk's maps of all scans, up to its end and up to where the next one's scans begin: four arrays in one."""

    @F.pandas_udf("array<double>")
    def udf(*args):
        out = []
        for chunk, states, rn, *values in zip(*args):
            _, rn, columns = _ordered(rn, values, reads)
            c, own = _run(steps, known, int(chunk) * size + 1, rn, columns, chunk, halo, states)
            cut = size - halo + _lead(steps)
            told = []
            for a, b in c.scans:
                p, q = composed(a[own:], b[own:])
                at = min(cut, len(p)) - 1
                told += [p[-1], q[-1], *((p[at], q[at]) if at >= 0 else (1.0, 0.0))]
            out.append(told)
        return pd.Series(out, dtype=object)

    return udf


def _folded(maps: DataFrame, symbol_type: str) -> DataFrame:
    """``(_symbol, _chunk, _states)``: the states with which each chunk begins; maps in order, with a symbol's states as all that is kept."""

    def run(batches):
        symbol, states, seen = None, None, False
        for b in batches:
            out = []
            for s, chunk, told in zip(*(c.to_pylist() for c in b.columns)):
                m = np.array(told, float).reshape(-1, 4)
                if not seen or s != symbol:
                    symbol, states, seen = s, np.zeros(len(m)), True
                # a state that can't be told yet stays unknown to the passes that need it
                out.append((s, chunk + 1, (m[:, 2] * states + m[:, 3]).tolist()))
                states = m[:, 0] * states + m[:, 1]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64()))], names=["_symbol", "_chunk", "_states"])

    ordered = maps.repartition("_symbol").sortWithinPartitions("_symbol", "_chunk")
    return ordered.mapInArrow(run, f"_symbol {symbol_type}, _chunk long, _states array<double>")


def _columns(steps, levels, size, halo, reads, adds, flags, kinds):
    """pandas UDF: the columns that the steps add, in the order in which the rows were packed."""

    @F.pandas_udf(f"struct<{kinds}>")
    def udf(*args):
        out = {n: [] for n in adds}
        for chunk, states, rn, *values in zip(*args):
            order, rn, columns = _ordered(rn, values, reads)
            c, _ = _run(steps, levels, int(chunk) * size + 1, rn, columns, chunk, halo, states)
            for n in adds:
                back = np.empty(len(order), object)
                v = c[n]
                back[order] = v.astype(bool) if n in flags else np.where(np.isnan(v), None, v)
                out[n].append(back)
        return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in out.items()}, columns=adds)

    return udf


def sma(n: int, column: str = "close", into: str | None = None):
    """Mean of the last ``n`` rows; null for the first n - 1."""

    @_step([into or f"sma{n}"], [column], n)
    def step(c: Chunk) -> None:
        x = c[column]
        c[step.adds[0]] = c.where(c.rn >= n, _ratio(sliding(np.add, x, n, 0.0), sliding(np.add, (~np.isnan(x)).astype(float), n, 0.0)))

    return step


def ema(n: int, column: str = "close", into: str | None = None):
    """Exponential mean, weight 2 / (n + 1), begun with the mean of the first ``n`` rows; null before."""
    a = 2.0 / (n + 1)

    @_step([into or f"ema{n}"], [column], 0, 1)
    def step(c: Chunk) -> None:
        x, begun = c[column], c.rn > n
        # plain sums up to row n, whose ratio is the mean
        keep, weight = np.where(begun, 1 - a, 1.0), np.where(begun, a * n, 1.0)
        total = c.scan(keep, np.where(np.isnan(x), 0.0, x * weight))
        c[step.adds[0]] = c.where(c.rn >= n, _ratio(total, c.scan(keep, np.where(np.isnan(x), 0.0, weight))))

    return step


def _rma(c: Chunk, x: np.ndarray, n: int, first: int, level: int = 1) -> np.ndarray:
    """Wilder mean with normalised weights (1 - 1/n)^age; ``x`` is missing before row ``first``, the mean before ``n`` values."""
    keep, held = 1 - 1.0 / n, ~np.isnan(x)
    mean = _ratio(c.scan(keep, np.where(held, x, 0.0), level), c.scan(keep, held.astype(float), level))
    return c.where(c.rn >= first + n - 1, mean)


def rsi(n: int = 14, column: str = "close", into: str = "rsi"):
    """100 * gains / (gains + losses) of Wilder means; null until ``n`` differences and where nothing moved."""

    @_step([into], [column], 1, 1)
    def step(c: Chunk) -> None:
        d = c.where(c.rn > 1, c[column] - previous(c[column]))
        up, down = _rma(c, np.maximum(d, 0.0), n, 2), _rma(c, np.maximum(-d, 0.0), n, 2)
        c[into] = _ratio(100 * up, up + down)

    return step


def adx(n: int = 14, into: str = "adx"):
    """Wilder mean of 100 * |P - M| / (P + M), P and M the Wilder means of upward and downward moves."""

    @_step([into], ["high", "low"], 1, 2)
    def step(c: Chunk) -> None:
        u, v = c.where(c.rn > 1, c["high"] - previous(c["high"])), c.where(c.rn > 1, previous(c["low"]) - c["low"])
        p = np.where(np.isnan(u), np.nan, np.where((u > v) & (u > 0), u, 0.0))
        m = np.where(np.isnan(v), np.nan, np.where((v > u) & (v > 0), v, 0.0))
        p, m = _rma(c, p, n, 2), _rma(c, m, n, 2)
        c[into] = _rma(c, _ratio(100 * np.abs(p - m), p + m), n, n + 1, level=2)

    return step


def donchian(entry: int = 20, leave: int = 10):
    """Highest high and lowest low of completed bars before this one; both null without ``entry`` of them."""

    @_step(["entry_high", "exit_low"], ["high", "low"], max(entry, leave) + 1)
    def step(c: Chunk) -> None:
        high, low = previous(sliding(np.maximum, c["high"], entry, -np.inf)), previous(sliding(np.minimum, c["low"], leave, np.inf))
        c["entry_high"] = c.where((c.rn > entry) & np.isfinite(high), high)
        c["exit_low"] = c.where((c.rn > entry) & np.isfinite(low), low)

    return step


def lagged(column: str, n: int = 1, into: str | None = None):
    """The number ``n`` rows before."""

    @_step([into or f"prev_{column}"], [column], n)
    def step(c: Chunk) -> None:
        c[step.adds[0]] = c.where(c.rn > n, previous(c[column], n))

    return step


def returns(column: str = "close", into: str = "move"):
    """(last - previous) / previous; null on the first bar."""

    @_step([into], [column], 1)
    def step(c: Chunk) -> None:
        before = c.where(c.rn > 1, previous(c[column]))
        c[into] = _ratio(c[column] - before, before)

    return step


def crossings(fast: str, slow: str):
    """``bull_cross`` and ``bear_cross``: this bar's order of two columns against the last one's; false while unknown."""

    @_step(["bull_cross", "bear_cross"], [fast, slow], 1, flags=True)
    def step(c: Chunk) -> None:
        f, s, pf, ps = c[fast], c[slow], c.where(c.rn > 1, previous(c[fast])), c.where(c.rn > 1, previous(c[slow]))
        c["bull_cross"], c["bear_cross"] = (f > s) & (pf <= ps), (f < s) & (pf >= ps)

    return step


def latest(bars: DataFrame) -> DataFrame:
    """The last row of each symbol, with all columns."""
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("_r")).select("symbol", "_r.*")
