"""Technical indicators: one row a bar from the first that has a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import divide_no_nan, ieee_divide, ieee_ln, safe_ln

from .frames import framed, in_block, numbered, past, recurrence

KEYS = ("symbol", "time", "rn")


def _rolling(bars: DataFrame, period: int, columns: dict[str, Column], first: int | None = None) -> DataFrame:
    df = framed(bars, before=period)
    df = df.withColumns(columns)
    return df.filter(F.col("own") & (F.col("rn") >= (period - 1 if first is None else first))).select(*KEYS, *columns)


def moving_average(bars: DataFrame, period: int = 12, column: str = "close") -> DataFrame:
    return _rolling(bars, period, {"ma": F.avg(column).over(past(period))})


def slope(bars: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Least squares over the last `period` values, at places 0 to period - 1."""
    found = F.regr_slope(F.col(column), F.col("rn").cast("double")).over(past(period))
    return _rolling(bars, period, {"slope": found, "intercept": F.avg(column).over(past(period)) - found * ((period - 1) / 2)})


def last_slope(bars: DataFrame, period: int | None = 14, column: str = "close") -> DataFrame:
    """One row a symbol: slope() of the last `period` values, or of the whole series if period is None."""
    if period:
        last = F.struct("slope", "intercept")
        return slope(bars, period, column).groupBy("symbol").agg(F.max_by(last, "rn").alias("l")).select("symbol", "l.*")
    at = F.col("rn").cast("double")
    return numbered(bars).groupBy("symbol").agg(F.regr_slope(F.col(column), at).alias("slope"), F.regr_intercept(F.col(column), at).alias("intercept"))


def _true_range() -> Column:
    before = F.lag("close").over(in_block())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def true_range(bars: DataFrame) -> DataFrame:
    return _rolling(bars, 1, {"true_range": _true_range()}, first=1)


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's: the mean of the first `period` ranges, then (previous * (period - 1) + range) / period."""
    df = framed(bars, before=period + 1).withColumn("tr", _true_range())
    seed = F.avg("tr").over(past(period))
    df = df.withColumn("u", F.when(F.col("rn") == period, seed).otherwise(F.col("tr") / period))
    df = df.filter(F.col("own") & (F.col("rn") >= period)).select(*KEYS, "u")
    return recurrence(df, {"atr": "u"}, (period - 1) / period).select(*KEYS, "atr")


def rsi(bars: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Seeded by the mean of the first period - 1 changes, then smoothed with `period`."""
    change = F.col(column) - F.lag(column).over(in_block())
    df = framed(bars, before=period + 1).withColumn("change", change)
    df = df.withColumns({"up": F.greatest("change", F.lit(0.0)), "down": F.greatest(-F.col("change"), F.lit(0.0))})
    seeded = {f"u_{c}": F.when(F.col("rn") == period - 1, F.avg(c).over(past(period - 1))).otherwise(F.col(c) / period) for c in ("up", "down")}
    df = df.withColumns(seeded).filter(F.col("own") & (F.col("rn") >= period - 1)).select(*KEYS, *seeded)
    df = recurrence(df, {"pos": "u_up", "neg": "u_down"}, (period - 1) / period)
    # a running sum leaves dust where the exact value is 0
    pos, neg = (F.when(F.col(c) > 1e-12, F.col(c)).otherwise(0.0) for c in ("pos", "neg"))
    value = F.when(neg > 0, 100 - 100 / (1 + pos / F.when(neg > 0, neg))).when(pos > 0, 100.0).otherwise(50.0)
    return df.select(*KEYS, value.alias("rsi"))


def _spread_of(column: str, period: int) -> Column:
    """Root of the summed squares of the first period - 1 values' distances from the window's mean."""
    values, mean = F.collect_list(column).over(past(period)), F.avg(column).over(past(period))
    head = F.slice(values, 1, period - 1)
    return F.sqrt(F.aggregate(F.transform(head, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x))


def spread_deviation(bars: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Not a standard deviation: summed, not averaged, and without the window's last value."""
    return _rolling(bars, period, {"deviation": _spread_of(column, period)})


def standard_deviation(bars: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    return _rolling(bars, period, {"deviation": F.stddev_pop(column).over(past(period))})


def bollinger(bars: DataFrame, period: int = 14, deviation: float = 2.0, column: str = "close") -> DataFrame:
    mean, wide = F.avg(column).over(past(period)), _spread_of(column, period) * deviation
    return _rolling(bars, period, {"middle": mean, "upper": mean + wide, "lower": mean - wide})


def garman_klass(bars: DataFrame, period: int = 14, ieee: bool = False) -> DataFrame:
    """Null where a bar of the window has no logarithm, NaN never: a negative mean gives null too.

    With `ieee` as in SQL: a low of 0 gives infinity, or NaN if the bar also opens or closes at 0,
    a ratio below 0 gives NaN, and a window skips its null bars.
    """
    divide, ln = (ieee_divide, ieee_ln) if ieee else (divide_no_nan, safe_ln)
    hl, co = ln(divide(F.col("high"), F.col("low"))), ln(divide(F.col("close"), F.col("open")))
    value = 0.5 * hl * hl - F.lit(0.38629436111989057) * co * co  # 2 ln 2 - 1
    mean = F.avg(value).over(past(period))
    if not ieee:
        mean = F.when(F.count(value).over(past(period)) == period, mean)
    return _rolling(bars, period, {"volatility": F.when(mean >= 0, F.sqrt(mean)) * F.sqrt(F.lit(float(period)))})


def body_range_ratio(bars: DataFrame) -> DataFrame:
    """|open - close| / (high - low), 0 for a bar without range. No frame, so no shuffle."""
    return bars.select("symbol", "time", divide_no_nan(F.abs(F.col("open") - F.col("close")), F.col("high") - F.col("low")).alias("ratio"))


def clipped_zscore_last(windows: DataFrame, column: str = "close", lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Per window: clip at its own quantiles (linear), then the last element's z-score; 0 without variance."""
    size = F.size(column)
    ordered = F.array_sort(column)

    def quantile(q: float) -> Column:
        at = F.lit(q) * (size - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, size - 1))
        return a + (b - a) * (at - low)

    low, high = quantile(lower), quantile(upper)
    clipped = F.transform(column, lambda x: F.greatest(F.least(x, F.col("__high")), F.col("__low")))
    df = windows.withColumns({"__low": low, "__high": high}).withColumn("__c", clipped)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("__m", total(F.col("__c")) / size)
    df = df.withColumn("__s", F.sqrt(total(F.transform("__c", lambda x: (x - F.col("__m")) * (x - F.col("__m")))) / size))
    score = F.when(F.col("__s") > 1e-12, (F.element_at("__c", -1) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return df.withColumn("zscore", score).drop("__low", "__high", "__c", "__m", "__s")


def layer_norm(windows: DataFrame, column: str = "close", epsilon: float = 1e-3) -> DataFrame:
    """Each window's values less their mean, over the root of variance + epsilon."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    df = windows.withColumn("__m", total(F.col(column)) / F.size(column))
    df = df.withColumn("__v", total(F.transform(column, lambda x: (x - F.col("__m")) * (x - F.col("__m")))) / F.size(column))
    return df.withColumn(column, F.transform(column, lambda x: (x - F.col("__m")) / F.sqrt(F.col("__v") + epsilon))).drop("__m", "__v")
