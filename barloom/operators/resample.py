"""Bars of a higher timeframe, from bar tables and from windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def timeframe_minutes(name: str) -> int:
    """Minutes of a timeframe name such as "4h"; blanks and case don't matter."""
    key = name.strip().lower()
    if key not in SECONDS:
        raise ValueError(f"Unknown timeframe: {name}")
    return SECONDS[key] // 60


def isoformat(column: str | Column) -> Column:
    """Epoch seconds as UTC text, whatever the session's zone."""
    column = F.col(column) if isinstance(column, str) else column
    days, rest = F.floor(column / 86400).cast("int"), F.pmod(column, F.lit(86400))
    part = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.concat(day, F.lit("T"), part(F.floor(rest / 3600)), F.lit(":"), part(F.floor(rest / 60) % 60), F.lit(":"), part(rest % 60), F.lit("+00:00"))


def resample(bars: DataFrame, minutes: int, current_minutes: int = 1, low_as_max: bool = False) -> DataFrame:
    """First open, last close, extremes, mean spread and summed volumes per epoch-aligned bucket.

    One partially aggregated shuffle. low_as_max gives the largest low of a bucket, for
    comparison with results that were made that way.
    """
    if minutes < current_minutes:
        raise ValueError("The target timeframe must not be below the current one")
    width = minutes * 60
    return bars.groupBy("symbol", (F.floor(F.col("time") / width) * width).cast("long").alias("bucket")).agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        (F.max("low") if low_as_max else F.min("low")).alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("tick_volume").alias("tick_volume"),
        F.sum("real_volume").alias("real_volume"),
        F.avg("spread").alias("spread"),
    ).withColumnRenamed("bucket", "time").select("symbol", "time", "open", "high", "low", "close", "tick_volume", "real_volume", "spread")


def resample_windows(windows: DataFrame, minutes: int, length: int, current_minutes: int = 1, low_as_max: bool = False) -> DataFrame:
    """The same inside each window row of arrays: the last k - 2 bars, for k = length div (minutes div current).

    k must be at least 3. Arrays only: a row never leaves its task.
    """
    if minutes < current_minutes:
        raise ValueError("The target timeframe must not be below the current one")
    kept = length // (minutes // current_minutes)
    if kept < 3:
        raise ValueError("Windows are too short for this timeframe")
    width = minutes * 60
    keys = F.array_distinct(F.transform("time", lambda t: F.floor(t / width).cast("long")))
    last = F.slice(keys, -F.least(F.size(keys), F.lit(kept - 2)), kept - 2)

    def of(name: str, bucket: Column) -> Column:
        pairs = F.arrays_zip("time", name)
        return F.transform(F.filter(pairs, lambda p: F.floor(p["time"] / width).cast("long") == bucket), lambda p: p[name])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    made = {
        "time": F.transform(last, lambda b: b * width),
        "open": F.transform(last, lambda b: F.element_at(of("open", b), 1)),
        "close": F.transform(last, lambda b: F.element_at(of("close", b), -1)),
        "high": F.transform(last, lambda b: F.array_max(of("high", b))),
        "low": F.transform(last, lambda b: (F.array_max if low_as_max else F.array_min)(of("low", b))),
        "spread": F.transform(last, lambda b: total(of("spread", b)) / F.size(of("spread", b))),
        "real_vol": F.transform(last, lambda b: total(of("real_volume", b))),
        "tick_vol": F.transform(last, lambda b: total(of("tick_volume", b))),
    }
    rest = [c for c in windows.columns if c not in ("time", "open", "close", "high", "low", "spread", "real_volume", "tick_volume")]
    # under other names first: an alias in the same list would be taken for the column
    return windows.select(*rest, *(c.alias(f"__{n}") for n, c in made.items())).withColumnsRenamed({f"__{n}": n for n in made})
