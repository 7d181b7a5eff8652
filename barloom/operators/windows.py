"""Strided windows of a series and what comes after them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import floor_divide
from barloom.sources.bars import FEATURES, REQUIRED

from .frames import framed, numbered


@dataclass(frozen=True)
class TimeTarget:
    """What happens in the next `rows` rows. mode: points, raw_difference or prices."""

    rows: int = 60
    mode: str = "points"


@dataclass(frozen=True)
class PointsTarget:
    """A target that ends after so many points; no mode of it is defined."""

    points: int = 100


def dedupe_last(df: DataFrame, keys: tuple[str, ...] = ("symbol", "time"), ingest: str = "ingest") -> DataFrame:
    """One row per key, the last by `ingest`; partially aggregated, so repeats don't travel."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ingest).alias("__last")).select(*keys, "__last.*").select(*df.columns)


def at_least(bars: DataFrame, length: int) -> DataFrame:
    """bars, if every symbol has at least `length` of them; an error on the first row otherwise."""
    df = numbered(bars)
    return df.filter(F.when(F.col("n") >= length, True).otherwise(F.raise_error(F.format_string("%s has %d rows, fewer than needed", "symbol", "n")).cast("boolean"))).drop("rn", "n")


def anchored(rn: Column, length: int, stride: int) -> Column:
    """Whether a row is the last of a window."""
    return (rn >= length - 1) & ((rn - (length - 1)) % stride == 0)


def windows(bars: DataFrame, length: int, stride: int = 1, features: tuple[str, ...] = ("time", *FEATURES), target: TimeTarget | PointsTarget | None = None, point: Column | float = 1.0) -> DataFrame:
    """One row a window: symbol, rn and end_time of its last bar, arrays of the features, and targets.

    A block's rows are gathered once, in order, and windows are slices of them: work goes with
    the number of windows, not with rows times length. One shuffle deals the blocks.
    With a target, windows whose horizon is cut off by the end of the series are left out.
    """
    if isinstance(target, PointsTarget):
        raise NotImplementedError("Only targets by time are defined")
    after = target.rows if target else 0
    columns = list(dict.fromkeys(("time", *features, *(("high", "low", "close") if target else ()))))
    point_column = isinstance(point, Column)
    df = framed(bars, before=length, after=after)
    if point_column:
        df = df.withColumn("__point", point)
    item = F.struct("rn", "own", *columns)
    blocks = df.groupBy("symbol", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("rows"), *([F.max("__point").alias("__point")] if point_column else []))
    series = F.array(F.struct(*(F.col("rows")[c].alias(c) for c in columns), F.get("rows", F.lit(0))["rn"].alias("__first")))

    def one(t: Column, rn: Column) -> Column:
        at = (rn - t["__first"]).cast("int")  # 0-based place in the block
        parts = [rn.alias("rn"), F.get(t["time"], at).alias("end_time"), *(F.slice(t[c], at - (length - 2), length).alias(c if c != "time" else "__time") for c in features)]
        if target:
            parts += [c.alias(n) for n, c in target_columns(target, F.col("__point") if point_column else F.lit(point), t, at).items()]
        return F.struct(*parts)

    anchors = F.transform(F.filter("rows", lambda x: x["own"] & anchored(x["rn"], length, stride) & (x["rn"] + after < F.col("n"))), lambda x: x["rn"])
    made = F.transform(series, lambda t: F.transform(anchors, lambda rn: one(t, rn)))[0]
    out = blocks.select("symbol", F.explode(made).alias("w")).select("symbol", "w.*")
    return out.withColumnRenamed("__time", "time") if "time" in features else out


def targets(bars: DataFrame, length: int, stride: int, target: TimeTarget, point: Column | float = 1.0) -> DataFrame:
    """windows() without the arrays."""
    return windows(bars, length, stride, (), target, point)


def target_columns(target: TimeTarget, point: Column, series: Column, at: Column) -> dict[str, Column]:
    """Targets of the bar at a place of a series (a struct of arrays).

    The lowest price counts from the entry down, and the last one too: it is positive when the price fell.
    """
    ahead = {c: F.slice(series[c], at + 2, target.rows) for c in ("high", "low", "close")}
    if target.mode == "prices":
        return {f"target_{c}": v for c, v in ahead.items()}
    if target.mode not in ("points", "raw_difference"):
        raise ValueError(f"Unknown mode: {target.mode}")
    make = (lambda a, b: floor_divide(a - b, point)) if target.mode == "points" else (lambda a, b: a - b)
    entry = F.get(series["close"], at)
    return {
        "target_highest": make(F.array_max(ahead["high"]), entry),
        "target_lowest": make(entry, F.array_min(ahead["low"])),
        "target_value": make(entry, F.get(series["close"], at + target.rows)),
        "entry": entry,
    }


def count_windows(n: Column, length: int, stride: int) -> Column:
    return F.greatest(F.lit(0), F.floor((n - length) / stride) + 1).cast("long")


def count_targets(n: Column, length: int, stride: int, rows: int) -> Column:
    """By the shorter series that has a horizon; may exceed what windows() returns by one."""
    return F.greatest(F.lit(0), F.floor((n - rows + 1 - length) / stride) + 1).cast("long")


def counts(bars: DataFrame, length: int, stride: int, rows: int) -> DataFrame:
    sized = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    return sized.select("symbol", "n", count_windows(F.col("n"), length, stride).alias("n_windows"), count_targets(F.col("n"), length, stride, rows).alias("n_targets"))


def tail(df: DataFrame, length: int, features: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Each array's last `length` elements; shorter ones stay whole."""
    return df.withColumns({c: F.slice(c, -F.least(F.size(c), F.lit(length)), length) for c in features if c in df.columns})


def end_times(df: DataFrame) -> DataFrame:
    return df.withColumn("end_time", F.element_at("time", -1))


def common_length(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Arrays of a row cut at the end to the shortest one's length."""
    least = F.least(*(F.size(c) for c in features)) if len(features) > 1 else F.size(features[0])
    return df.withColumns({c: F.slice(c, F.lit(1), least) for c in features})


def flatten(df: DataFrame, features: tuple[str, ...], length: int) -> DataFrame:
    """Arrays as columns name__0, name__1, ...; other columns stay."""
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *(F.get(c, F.lit(i)).alias(f"{c}__{i}") for c in features for i in range(length)))


def unflatten(df: DataFrame, features: tuple[str, ...], length: int) -> DataFrame:
    own = {f"{c}__{i}" for c in features for i in range(length)}
    rest = [c for c in df.columns if c not in own]
    return df.select(*rest, *(F.array(*(f"{c}__{i}" for i in range(length))).alias(c) for c in features))


def stacked(df: DataFrame, features: tuple[str, ...], name: str = "vector") -> DataFrame:
    """Features one after the other, in the order of their names, as one array."""
    kinds = dict(df.dtypes)
    parts = [F.col(c).cast("array<double>") if kinds[c].startswith("array") else F.array(F.col(c).cast("double")) for c in sorted(features)]
    return df.withColumn(name, F.concat(*parts))


def shards(df: DataFrame, count: int) -> DataFrame:
    """Near-equal contiguous ranges of a symbol's windows, the larger ones first: shard 0 to count - 1."""
    df = numbered(df.withColumnRenamed("rn", "__anchor").withColumn("time", F.col("end_time")))
    size, more = F.floor(F.col("n") / count), F.col("n") % count
    shard = F.when(F.col("rn") < more * (size + 1), F.floor(F.col("rn") / (size + 1))).otherwise(more + F.floor((F.col("rn") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return df.withColumn("shard", shard.cast("int")).drop("rn", "n", "time").withColumnRenamed("__anchor", "rn")


def keep_class(df: DataFrame, predicted: str, label: int) -> DataFrame:
    """Rows whose auxiliary prediction is `label`."""
    return df.filter(F.col(predicted) == label)


def without_class(df: DataFrame, label: str, excluded: int = -1) -> DataFrame:
    """df less one class; -1 excludes none."""
    return df if excluded == -1 else df.filter(F.col(label) != excluded)


def take_batches(df: DataFrame, batches: int, batch_size: int, *order: str) -> DataFrame:
    """The first batches in a stated order; a negative count takes all."""
    return df if batches < 0 else df.orderBy(*order).limit(batches * batch_size)


def shuffled(df: DataFrame, seed: int = 44) -> DataFrame:
    """Rows in an order of chance that reruns share."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)


def input_spec(df: DataFrame, label: str = "label") -> dict[str, str]:
    """Names and types of a frame's features."""
    return {c: t for c, t in df.dtypes if c != label}
