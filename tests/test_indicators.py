import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barloom.operators import frames, indicators

BAR = "symbol string, time long, open double, high double, low double, close double, tick_volume double, real_volume double, spread double"


def bars_of(spark, close, high=None, low=None, open_=None, symbol="s"):
    high, low, open_ = high or close, low or close, open_ or close
    return spark.createDataFrame([(symbol, 60 * i, float(o), float(h), float(x), float(c), 1.0, 1.0, 0.0) for i, (o, h, x, c) in enumerate(zip(open_, high, low, close))], BAR)


def values(df, column):
    return [r[column] for r in df.orderBy("time").collect()]


def test_fixtures(spark):
    six = bars_of(spark, [1, 2, 3, 4, 5, 6])
    assert values(indicators.moving_average(six, 3), "ma") == [2, 3, 4, 5]
    last = indicators.last_slope(six, 3).first()
    assert (last["slope"], last["intercept"]) == pytest.approx((1, 4))
    assert tuple(indicators.last_slope(six, None).first())[1:] == pytest.approx((1, 1))
    three = bars_of(spark, [1, 2, 3])
    assert values(indicators.spread_deviation(three, 3), "deviation") == [1.0]
    assert values(indicators.standard_deviation(three, 3), "deviation") == pytest.approx([0.81649658])
    band = indicators.bollinger(three, 3).first()
    assert (band["middle"], band["upper"], band["lower"]) == (2, 4, 0)
    for series, want in (([1, 2, 3, 4, 5], 100), ([2, 2, 2, 2, 2], 50), ([5, 4, 3, 2, 1], 0)):
        assert set(values(indicators.rsi(bars_of(spark, series), 3), "rsi")) == {want}
    wide = bars_of(spark, [2, 3, 5, 4, 6], [3, 4, 6, 5, 7], [1, 2, 3, 3, 4])
    assert values(indicators.true_range(wide), "true_range") == [2, 3, 2, 3]
    assert values(indicators.atr(wide, 2), "atr") == pytest.approx([2.5, 2.25, 2.625])
    body = bars_of(spark, [2, 2], [3, 2], [1, 2], [1, 2])
    assert values(indicators.body_range_ratio(body), "ratio") == [0.5, 0]


def test_volatility_without_logarithm(spark):
    zero = bars_of(spark, [2, 2, 2, 2], [3, 3, 3, 3], [0, 1, 1, 1])
    got = values(indicators.garman_klass(zero, 2), "volatility")
    assert got[0] is None and got[1:] == pytest.approx([np.log(3) * np.sqrt(0.5) * np.sqrt(2)] * 2)


def test_volatility_as_ieee(spark):
    zero = bars_of(spark, [2, 2, 2, 2], [3, 3, 3, 3], [0, 1, 1, 1])
    assert values(indicators.garman_klass(zero, 2, ieee=True), "volatility") == pytest.approx([np.inf] + [np.log(3) * np.sqrt(0.5) * np.sqrt(2)] * 2)


def wilder(x, p, kind):
    if kind == "rsi":
        d = np.diff(x)
        up, down = np.maximum(d, 0), np.maximum(-d, 0)
        a, b = up[: p - 1].mean(), down[: p - 1].mean()
        out = []
        for i in range(p - 1, len(x)):
            if i >= p:
                a, b = (a * (p - 1) + up[i - 1]) / p, (b * (p - 1) + down[i - 1]) / p
            out.append(100 - 100 / (1 + a / b) if b > 1e-12 else 100.0 if a > 1e-12 else 50.0)
        return out


@pytest.mark.parametrize("period", [2, 14, 60])
def test_long_recursion_in_blocks(spark, period):
    """Longer than a block of the recursion and of the frames."""
    rng = np.random.default_rng(period)
    x = np.cumsum(rng.normal(0, 1, 6000)) + 500
    got = values(indicators.rsi(bars_of(spark, list(x)), period), "rsi")
    assert np.allclose(got, wilder(x, period, "rsi"), atol=1e-7)


def test_blocks_equal_one_window(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = bars_of(spark, list(rng.normal(100, 5, 300))).unionByName(bars_of(spark, list(rng.normal(9, 1, 45)), symbol="t"))
    want = {(r["symbol"], r["rn"]): r["ma"] for r in indicators.moving_average(df, 12).collect()}
    monkeypatch.setattr(frames.framed, "__defaults__", (0, 0, 16))
    monkeypatch.setattr(frames.numbered, "__defaults__", (600,))
    got = {(r["symbol"], r["rn"]): r["ma"] for r in indicators.moving_average(df, 12).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1000), min_size=16, max_size=40))
def test_rsi_between_0_and_100(spark, close):
    assert all(0 <= v <= 100 for v in values(indicators.rsi(bars_of(spark, close), 14), "rsi"))


@pytest.mark.parametrize("block, group, levels", [(512, 256, 2), (8, 4, 2), (3, 2, 3), (8, 4, 0), (16, 1, 1)])
def test_recurrence_in_levels(spark, block, group, levels):
    rng = np.random.default_rng(block)
    series = {"a": rng.normal(size=1100), "b": rng.normal(size=8), "c": rng.normal(size=1)}
    rows = spark.createDataFrame([(s, i, float(x), float(-2 * x)) for s, u in series.items() for i, x in enumerate(u)], "symbol string, rn long, u double, v double")
    got = {(r["symbol"], r["rn"]): (r["y"], r["z"]) for r in frames.recurrence(rows, {"y": "u", "z": "v"}, 0.9, block, group, levels).collect()}
    assert len(got) == sum(map(len, series.values()))
    for s, u in series.items():
        y = 0.0
        for i, x in enumerate(u):
            y = 0.9 * y + x
            assert got[s, i] == pytest.approx((y, -2 * y), abs=1e-9)
