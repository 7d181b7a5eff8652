import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_indicators import bars_of

from barloom.functions.numeric import divide_no_nan, floor_divide, safe_ln
from barloom.operators import frames, resample, windows

CLOSE = [10, 11, 12, 11, 10, 9, 10, 12]


def test_targets(spark):
    df = bars_of(spark, CLOSE, [c + 1 for c in CLOSE], [c - 1 for c in CLOSE])
    got = windows.windows(df, 3, 2, target=windows.TimeTarget(2, "raw_difference")).orderBy("rn").collect()
    assert [(r["rn"], r["target_highest"], r["target_lowest"], r["target_value"]) for r in got] == [(2, 0, 3, 2), (4, 1, 2, 0)]
    assert got[0]["close"] == [10, 11, 12] and got[0]["time"] == [0, 60, 120] and got[0]["end_time"] == 120
    prices = windows.targets(df, 3, 2, windows.TimeTarget(2, "prices")).orderBy("rn").first()
    assert prices["target_close"] == [11, 10] and prices["target_high"] == [12, 11]
    count = windows.counts(df, 3, 2, 2).first()
    assert (count["n_windows"], count["n_targets"]) == (3, 3)
    with pytest.raises(NotImplementedError):
        windows.windows(df, 3, 2, target=windows.PointsTarget())
    with pytest.raises(ValueError):
        windows.targets(df, 3, 2, windows.TimeTarget(2, "other"))


def test_windows_are_numpy_windows(spark):
    x = np.random.default_rng(3).normal(50, 3, 500)
    got = windows.windows(bars_of(spark, list(x)), 24, 5).orderBy("rn").collect()
    want = np.lib.stride_tricks.sliding_window_view(x, 24)[::5]
    assert np.array_equal(np.array([r["close"] for r in got]), want)


@given(st.integers(0, 400), st.integers(1, 50), st.integers(1, 20))
def test_count_formula(n, length, stride):
    assert max(0, (n - length) // stride + 1) == len(range(length - 1, n, stride))


def test_floor_division(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.integers(-3000, 3000, 4000) * 0.01, 2)
    b = rng.choice([0.1, 0.01, 0.05, 0.0001], 4000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)] + [(1.0, 0.1)], "a double, b double")
    got = [r[0] for r in df.select(floor_divide(F.col("a"), F.col("b"))).collect()]
    assert got[:-1] == list(a // b) and got[-1] == 9
    zero = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in zero.select(divide_no_nan(F.col("a"), F.col("b")), safe_ln(F.col("b"))).collect()] == [(0, None), (0, None), (2, pytest.approx(np.log(3)))]


def test_tail_flatten_and_dedupe(spark):
    keys = ("time", "open", "high", "close", "low", "spread", "tick_volume", "real_volume")
    df = spark.createDataFrame([tuple([float(i + k) for i in range(4)] for k in range(8))], ", ".join(f"{k} array<double>" for k in keys))
    got = windows.tail(df, 3).first()
    assert all(len(got[k]) == 3 for k in keys) and got["close"] == [4, 5, 6]
    assert windows.tail(df, 9).first()["close"] == [3, 4, 5, 6]
    flat = windows.flatten(df, ("open", "close"), 4)
    assert "open__3" in flat.columns and windows.unflatten(flat, ("open", "close"), 4).select(*keys).first() == df.first()
    rows = spark.createDataFrame([("s", 1, 1.0, 1), ("s", 1, 2.0, 2), ("s", 2, 5.0, 1)], "symbol string, time long, close double, ingest int")
    assert sorted(r["close"] for r in windows.dedupe_last(rows).collect()) == [2, 5]
    with pytest.raises(Exception, match="fewer than needed"):
        windows.at_least(bars_of(spark, CLOSE), 9).count()
    assert windows.at_least(bars_of(spark, CLOSE), 8).count() == 8


def test_resample(spark):
    df = bars_of(spark, [6, 4], [6, 8], [5, 3], [5, 6]).withColumn("tick_volume", F.col("time") / 60 + 1)
    got = resample.resample(df, 5).first()
    assert (got["open"], got["close"], got["high"], got["low"], got["tick_volume"]) == (5, 4, 8, 3, 3)
    assert resample.resample(df, 5, low_as_max=True).first()["low"] == 5
    with pytest.raises(ValueError):
        resample.resample(df, 1, 5)
    with pytest.raises(ValueError):
        resample.resample_windows(df, 5, 14)
    assert resample.timeframe_minutes(" 4H ") == 240
    with pytest.raises(ValueError):
        resample.timeframe_minutes("7m")
    x = list(np.arange(1.0, 61))
    made = resample.resample_windows(windows.windows(bars_of(spark, x), 60, 1), 10, 60).first()
    assert made["time"] == [1200, 1800, 2400, 3000] and made["open"] == [21, 31, 41, 51] and made["close"] == [30, 40, 50, 60] and made["low"] == [21, 31, 41, 51]
    assert made["tick_vol"] == [10] * 4


def test_windows_over_block_borders(spark, monkeypatch):
    x = list(np.random.default_rng(4).normal(50, 3, 200))
    df = bars_of(spark, x).unionByName(bars_of(spark, x[:40], symbol="t"))
    target = windows.TimeTarget(7, "raw_difference")
    take = lambda: sorted((r["symbol"], r["rn"], tuple(r["close"]), r["target_value"], r["target_highest"]) for r in windows.windows(df, 24, 3, target=target).collect())
    want = take()
    monkeypatch.setattr(frames.framed, "__defaults__", (0, 0, 16))
    assert take() == want and len(want) == len(range(23, 193, 3)) + len(range(23, 33, 3))
