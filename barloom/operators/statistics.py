"""Statistics of targets, labels and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .training import place

PERCENTILES = (25, 50, 75, 90, 95)


def quantiles(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("symbol",), percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Exact linear percentiles: one row per group and column, p25, p50, ..."""
    at = [p / 100 for p in percentiles]
    found = df.groupBy(*by).agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in columns))
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("q")) for c in columns))).alias("r")
    return found.select(*by, names).select(*by, "r.name", *(F.get("r.q", F.lit(i)).alias(f"p{p}") for i, p in enumerate(percentiles)))


def compare_counts(df: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    high, low = F.col("target_highest"), F.col("target_lowest")
    return df.groupBy(*by).agg(F.count_if(high > low).alias("highest_gt_lowest"), F.count_if(low > high).alias("lowest_gt_highest"), F.count_if(high == low).alias("equal"), F.count("*").alias("total"))


def min_target_points(df: DataFrame, percentile: int = 50, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The mean of the highest's and the lowest's percentile, cut toward 0."""
    q = percentile / 100
    mean = (F.percentile("target_highest", F.lit(q)) + F.percentile("target_lowest", F.lit(q))) / 2
    return df.groupBy(*by).agg(mean.cast("long").alias("min_points"))


def labelled(targets: DataFrame, min_points: Column | str = "min_points") -> DataFrame:
    """label: 0 buy, 1 sell, 2 hold, by the side that reaches min_points and the other one."""
    high, low, least = F.col("target_highest"), F.col("target_lowest"), F.col(min_points) if isinstance(min_points, str) else min_points
    return targets.withColumn("label", F.when((high >= least) & (high > low), 0).when((low >= least) & (low > high), 1).otherwise(2))


def distribution(df: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and percent of each class."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("rows"))
    return counts.withColumn("percent", 100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy(*by)))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """rows / (classes * rows of the class)."""
    counts, all_ = df.groupBy(label).agg(F.count("*").alias("rows")), Window.partitionBy()
    return counts.withColumn("weight", F.sum("rows").over(all_) / (F.count("*").over(all_) * F.col("rows")))


TINY = 1.1754943508222875e-38  # the least normal 32-bit float


def output_bias(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """Log of each class's share; absent ones count TINY, then shares are scaled to 1."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("rows"))
    all_ = spark.range(classes).withColumnRenamed("id", "label").join(F.broadcast(counts.filter(F.col("label").between(0, classes - 1))), "label", "left")
    one = Window.partitionBy()
    share = F.greatest(F.coalesce("rows", F.lit(0)) / F.sum("rows").over(one), F.lit(TINY))
    shares = all_.withColumn("share", share)
    return shares.select("label", F.ln(F.col("share") / F.sum("share").over(one)).alias("bias"))


def class_id(column: str) -> Column:
    """The place of the largest element of a one-hot array."""
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def dense_ids(train: DataFrame, other: DataFrame, label: str = "label") -> DataFrame:
    """label and class_id 0..k-1 over both tables' labels; ranks run over the distinct labels only."""
    known = train.select(label).unionByName(other.select(label)).distinct()
    return known.withColumn("class_id", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def anova_f(df: DataFrame, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """feature, f and importance (f by the largest f). Classes of one row don't count; 0 where F isn't defined."""
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features))).alias("e")).select(label, "e.*")
    groups = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("ss")).filter("n > 1")
    total = groups.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between")
    )
    f = F.when((F.col("k") >= 2) & (F.col("within") > 0) & (F.col("n") > F.col("k")), (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).otherwise(0.0)
    scored = total.select("feature", f.alias("f"))
    top = F.max("f").over(Window.partitionBy())
    return scored.withColumn("importance", F.col("f") / F.when(top > 0, top).otherwise(1.0))


def zscored(df: DataFrame, train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """columns less the training mean, by the training deviation + 1e-8; one row of statistics is broadcast."""
    stats = train.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-8)).alias(c) for c in columns))


def percentile(df: DataFrame, column: str, share: float) -> float | None:
    """Exact linear percentile of a whole column without nulls; None for no rows.

    Ranks are counted in ranges (training.place), and only the two rows beside the
    wanted rank come to the driver: no task holds the column or its distinct values.
    """
    own = df.select(F.col(column).cast("double").alias("x"))
    at = (own.count() - 1) * share
    if at < 0:
        return None
    low = int(at)
    found = dict(place(own, ("x",)).filter(F.col("place").between(low, low + (at > low))).select("place", "x").collect())
    return found[low] + (found[low + 1] - found[low]) * (at - low) if at > low else found[low]


def imputed(df: DataFrame, train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Infinite, NaN and null values take the training median of the finite ones (null if there are none)."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    medians = {c: percentile(train.select(finite(c).alias("x")).dropna(), "x", 0.5) for c in columns}
    return df.select(*(c for c in df.columns if c not in columns), *(F.coalesce(finite(c), F.lit(m).cast("double")).alias(c) for c, m in medians.items()))


def eligibility(df: DataFrame, features: tuple[str, ...], label: str = "label", by: tuple[str, ...] = ("symbol",), min_signals: int = 400, min_sequences: int = 1000, max_ratio: float = 4.0) -> DataFrame:
    """Whether a data set is fit for training, and the first reason why not; 0 is buy and 1 sell."""
    values = F.array(*(F.col(c).cast("double") for c in features))
    finite = F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    k = len(features)
    stats = df.groupBy(*by).agg(
        F.count("*").alias("sequences"), F.count_if(F.col(label) == 0).alias("buy"), F.count_if(F.col(label) == 1).alias("sell"), F.bool_and(finite).alias("finite"),
        (F.sum(total(F.transform(values, lambda x: x * x))) / (F.count("*") * k) - F.pow(F.sum(total(values)) / (F.count("*") * k), 2)).alias("variance"),
    )
    ratio = F.greatest("buy", "sell") / F.greatest(F.lit(1), F.least("buy", "sell"))
    reason = (
        F.when(~F.col("finite"), "not finite")
        .when(F.col("buy") + F.col("sell") <= min_signals, "too few signals")
        .when(F.col("sequences") <= min_sequences, "too few sequences")
        .when((F.col("buy") == 0) | (F.col("sell") == 0), "one class only")
        .when(ratio >= max_ratio, "unbalanced")
        .when(F.col("variance") <= 1e-10, "no variance")
        .otherwise("ok")
    )
    return stats.select(*by, "sequences", "buy", "sell", ratio.alias("ratio"), "variance", reason.alias("reason"), (reason == "ok").alias("eligible"))
