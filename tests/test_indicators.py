"""Indicators against direct definitions, over chunk boundaries and on degenerate series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import indicators as ind

T0 = dt.datetime(2024, 1, 1)


def frame(spark, close, symbol="A"):
    rows = [(symbol, T0 + dt.timedelta(hours=i), float(c), float(c) + 1, float(c) - 1, float(c)) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double")


def values(df, column):
    return np.array([np.nan if r[column] is None else r[column] for r in df.orderBy("ts").collect()])


def rma(x, n):
    return x.ewm(alpha=1 / n, min_periods=n, adjust=True).mean()


def direct(close):
    s = pd.Series(close, dtype=float)
    out = {"sma5": s.rolling(5).mean()}
    e = s.copy()
    e[:] = np.nan
    if len(s) >= 9:
        e.iloc[8] = s[:9].mean()
        for i in range(9, len(s)):
            e.iloc[i] = 0.2 * s[i] + 0.8 * e.iloc[i - 1]
    out["ema9"] = e
    d = s.diff()
    up, dn = rma(d.clip(lower=0).where(d.notna()), 14), rma((-d).clip(lower=0).where(d.notna()), 14)
    out["rsi"] = (100 * up / (up + dn)).where(up + dn > 0)
    h, low = s + 1, s - 1
    u, v = h.diff(), -low.diff()
    p = u.where((u > v) & (u > 0), 0).where(u.notna())
    m = v.where((v > u) & (v > 0), 0).where(v.notna())
    p, m = rma(p, 14), rma(m, 14)
    out["adx"] = rma((100 * (p - m).abs() / (p + m)).where(p + m > 0), 14)
    return out


@pytest.mark.parametrize("chunk", [64, 1024])
def test_against_direct_definitions(spark, chunk):
    close = 100 + np.cumsum(np.random.default_rng(1).normal(size=400))
    got = ind.enrich(frame(spark, close), ind.sma(5), ind.ema(9), ind.rsi(), ind.adx(), chunk=chunk)
    for name, want in direct(close).items():
        np.testing.assert_allclose(values(got, name), want, rtol=1e-9, atol=1e-9)


LONG = 5000


@pytest.fixture(scope="module")
def long_close():
    return 50 + np.abs(np.cumsum(np.random.default_rng(7).normal(size=LONG)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 200, 500])
def test_ema_of_any_length(spark, long_close, n):
    want, a = np.full(LONG, np.nan), 2 / (n + 1)
    want[n - 1] = long_close[:n].mean()
    for i in range(n, LONG):
        want[i] = a * long_close[i] + (1 - a) * want[i - 1]
    got = ind.enrich(frame(spark, long_close), ind.ema(n, into="x"), ind.sma(7))
    np.testing.assert_allclose(values(got, "x"), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 14, 90])
def test_rsi_of_any_length(spark, long_close, n):
    d = pd.Series(long_close).diff()
    up, dn = rma(d.clip(lower=0).where(d.notna()), n), rma((-d).clip(lower=0).where(d.notna()), n)
    got = ind.enrich(frame(spark, long_close), ind.rsi(n))
    np.testing.assert_allclose(values(got, "rsi"), 100 * up / (up + dn), rtol=1e-9, atol=1e-9)


def test_windows_longer_than_a_chunk(spark, long_close):
    got = ind.enrich(frame(spark, long_close), ind.sma(1500), ind.donchian(1500, 1200), ind.ema(3), ind.lagged("close", 1100))
    s = pd.Series(long_close)
    np.testing.assert_allclose(values(got, "sma1500"), s.rolling(1500).mean(), rtol=1e-9)
    full = pd.Series(np.arange(LONG) >= 1500)
    np.testing.assert_allclose(values(got, "entry_high"), (s + 1).rolling(1500).max().shift().where(full), rtol=1e-12)
    np.testing.assert_allclose(values(got, "exit_low"), (s - 1).rolling(1200).min().shift().where(full), rtol=1e-12)
    np.testing.assert_allclose(values(got, "prev_close"), s.shift(1100), rtol=1e-12)
    direct_ema = s.copy()
    direct_ema[:2], direct_ema[2] = np.nan, s[:3].mean()
    for i in range(3, LONG):
        direct_ema[i] = 0.5 * s[i] + 0.5 * direct_ema[i - 1]
    np.testing.assert_allclose(values(got, "ema3"), direct_ema, rtol=1e-9)


def test_many_chunks_agree_with_one_series(spark):
    close = 50 + np.cumsum(np.random.default_rng(2).normal(size=3000))
    got = ind.enrich(frame(spark, close), ind.sma(5), ind.ema(9), ind.rsi(), ind.adx())
    assert got.count() == 3000
    for name, want in direct(close).items():
        np.testing.assert_allclose(values(got, name), want, rtol=1e-9, atol=1e-9)


def test_warm_up_and_flat_prices(spark):
    got = ind.enrich(frame(spark, [7.0] * 40), ind.sma(5), ind.ema(9), ind.rsi(), ind.adx(), ind.donchian())
    assert np.isnan(values(got, "sma5"))[:4].all() and (values(got, "sma5")[4:] == 7).all()
    assert np.isnan(values(got, "rsi")).all() and np.isnan(values(got, "adx")).all()
    assert np.isnan(values(got, "entry_high"))[:20].all() and (values(got, "entry_high")[20:] == 8).all()


def test_short_and_empty(spark):
    steps = (ind.sma(200), ind.rsi(), ind.adx(), ind.returns(), ind.crossings("close", "open"))
    one = ind.enrich(frame(spark, [5.0]), *steps).collect()
    assert len(one) == 1 and one[0]["move"] is None and not one[0]["bull_cross"]
    assert ind.enrich(frame(spark, [5.0]).where("false"), *steps).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1000), min_size=2, max_size=60))
def test_bounds(spark, close):
    rows = ind.enrich(frame(spark, close), ind.rsi(), ind.ema(9), ind.donchian()).collect()
    for r in rows:
        assert r["rsi"] is None or -1e-6 <= r["rsi"] <= 100 + 1e-6
        assert r["ema9"] is None or min(close) - 1e-6 <= r["ema9"] <= max(close) + 1e-6
        assert r["entry_high"] is None or r["entry_high"] >= r["exit_low"]


def test_average_longer_than_all_chunks(spark):
    n, length = 100_000, 120_000
    close = 50 + np.abs(np.cumsum(np.random.default_rng(3).normal(size=length)))
    rows = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=length, freq="min"), "close": close}))
    got = ind.enrich(rows, ind.ema(n, into="x")).select("rn", "x").toPandas().sort_values("rn")["x"].to_numpy(float)
    a, want = 2 / (n + 1), np.full(length, np.nan)
    want[n - 1] = close[:n].mean()
    for i in range(n, length):
        want[i] = a * close[i] + (1 - a) * want[i - 1]
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 64])
def test_sliding_windows(n):
    x = np.random.default_rng(n).normal(size=50)
    x[[3, 17, 18]] = np.nan
    for op, nothing, direct_op in ((np.add, 0.0, np.nansum), (np.maximum, -np.inf, lambda v: np.nanmax(v, initial=-np.inf))):
        want = [direct_op(x[max(0, i - n + 1) : i + 1]) for i in range(50)]
        np.testing.assert_allclose(ind.sliding(op, x, n, nothing), want, atol=1e-12)


def test_composed_maps():
    rng = np.random.default_rng(1)
    a, b, s, want = rng.uniform(0, 1, 77), rng.normal(size=77), 3.0, []
    for p, q in zip(a, b):
        s = p * s + q
        want.append(s)
    p, q = ind.composed(a, b)
    np.testing.assert_allclose(p * 3.0 + q, want, rtol=1e-12)


def test_scans_over_scans_and_windows_over_scans(spark):
    close = 50 + np.abs(np.cumsum(np.random.default_rng(9).normal(size=700)))
    got = ind.enrich(frame(spark, close), ind.ema(9), ind.sma(30, "ema9", into="mean"), ind.lagged("ema9", 40, into="far"), ind.adx(), chunk=150)
    e = pd.Series(direct(close)["ema9"])
    np.testing.assert_allclose(values(got, "far"), e.shift(40), rtol=1e-9)
    np.testing.assert_allclose(values(got, "mean")[60:], e.rolling(30).mean()[60:], rtol=1e-9)
    np.testing.assert_allclose(values(got, "adx"), direct(close)["adx"], rtol=1e-9)


def test_columns_of_the_user_and_rows_without_a_place(spark):
    rows = frame(spark, range(10, 60)).selectExpr("*", "'mine' as _own", "array(1) as _rows", "map('a', 1) as m", "7 as _z")
    odd = rows.limit(1).selectExpr("cast(null as string) as symbol", "ts", "open", "high", "low", "close", "_own", "_rows", "m", "_z")
    odd = odd.unionByName(rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    got = ind.enrich(rows.unionByName(odd), ind.sma(5), ind.crossings("close", "sma5"), chunk=8)
    assert got.columns == [*rows.columns, "rn", "sma5", "bull_cross", "bear_cross"]
    assert {(r["_own"], tuple(r["_rows"]), r["m"]["a"], r["_z"]) for r in got.collect()} == {("mine", (1,), 1, 7)} and got.count() == 50


def test_missing_prices_count_nothing(spark):
    close = [float(v) for v in range(1, 41)]
    close[10] = close[25] = float("nan")
    rows = frame(spark, close)
    rows = rows.withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = ind.enrich(rows, ind.sma(3), ind.ema(3), chunk=7)
    s = pd.Series(close)
    np.testing.assert_allclose(values(got, "sma3"), s.rolling(3, min_periods=1).mean().where(np.arange(40) >= 2))
    total = weight = 0.0
    want = []
    for i, v in enumerate(close):
        keep, w = (1.0, 1.0) if i < 3 else (0.5, 1.5)
        held = v == v
        total, weight = keep * total + (w * v if held else 0), keep * weight + (w if held else 0)
        want.append(total / weight if i >= 2 else np.nan)
    np.testing.assert_allclose(values(got, "ema3"), want, rtol=1e-12)


def test_few_sorts(spark):
    """One to number the rows, one for each fold; the rows themselves are exchanged once for all passes."""
    rows = ind.enrich(frame(spark, range(50)), ind.adx())
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") <= 3 and plan.count("ReusedExchange") >= 2, plan
