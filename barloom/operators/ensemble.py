"""Votes of several models, filters and the signals that come of them. Classes: 0 buy, 1 sell, 2 hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUY, SELL, HOLD = 0, 1, 2


def vote(predictions: DataFrame, rule: str, row: str = "row_id", components: int | None = None, rows_of: DataFrame | None = None) -> DataFrame:
    """row and prediction; rule: unanimous, majority or priority_tiebreak. predictions: row, prediction, priority.

    A row whose votes name no class holds, and so does each row of `rows_of` that has no votes at all.

    Majority is the largest count; a tie holds, or with priority_tiebreak goes to the tied class of
    the least priority number. One partially aggregated shuffle: each row keeps a count and a least
    priority for each class. With `components`, a row that has another number of votes is an error.
    """
    if rule not in ("unanimous", "majority", "priority_tiebreak"):
        raise ValueError(f"Unknown rule: {rule}")
    each = []
    for c in (BUY, SELL, HOLD):
        own = F.col("prediction") == c
        each += [F.count_if(own).alias(f"c{c}"), F.min(F.when(own, F.col("priority"))).alias(f"p{c}")]
    entries = F.array(*(F.struct(F.col(f"c{c}").alias("c"), F.col(f"p{c}").alias("p"), F.lit(c).alias("prediction")) for c in (BUY, SELL, HOLD)))
    rows = predictions.groupBy(row).agg(*each).select(row, F.filter(entries, lambda x: x["c"] > 0).alias("v"), (F.col("c0") + F.col("c1") + F.col("c2")).alias("votes"))
    if components is not None:
        rows = rows.filter(F.when(F.col("votes") == components, True).otherwise(F.raise_error("Components disagree on the number of rows").cast("boolean")))
    most = F.array_max(F.transform("v", lambda x: x["c"]))
    tied = F.filter("v", lambda x: x["c"] == most)
    if rule == "unanimous":
        out = F.when(F.size("v") == 1, F.get("v", F.lit(0))["prediction"]).otherwise(HOLD)
    elif rule == "majority":
        out = F.when(F.size(tied) == 1, F.get(tied, F.lit(0))["prediction"]).otherwise(HOLD)
    else:
        out = F.array_min(F.transform(tied, lambda x: F.struct(x["p"], x["prediction"])))["prediction"]
    voted = rows.select(row, F.coalesce(out, F.lit(HOLD)).cast("int").alias("prediction"))
    if rows_of is None:
        return voted
    return rows_of.select(row).distinct().join(voted, row, "left").select(row, F.coalesce("prediction", F.lit(HOLD)).cast("int").alias("prediction"))


def filter_override(predictions: DataFrame, filters: DataFrame, filter_class: int, row: str = "row_id") -> DataFrame:
    """Rows where the filter's model didn't say filter_class hold."""
    other = filters.select(row, F.col("prediction").alias("__filter"))
    out = F.when(F.col("__filter") == filter_class, F.col("prediction")).otherwise(HOLD)
    return predictions.join(other, row).select(row, out.cast("int").alias("prediction"))


def signals(windows: DataFrame, gates: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """timestamp, signal_type and price of windows whose class passed its gate (buy_valid, sell_valid)."""
    kind = F.when(F.col("prediction") == BUY, "BUY").when(F.col("prediction") == SELL, "SELL").otherwise("HOLD")
    joined = windows.join(gates.select(*by, "buy_valid", "sell_valid"), list(by))
    kept = joined.filter(((F.col("prediction") == BUY) & F.col("buy_valid")) | ((F.col("prediction") == SELL) & F.col("sell_valid")))
    return kept.select(*by, F.element_at("time", -1).alias("timestamp"), kind.alias("signal_type"), F.element_at("close", -1).alias("price"))


def ordered_signals(found: DataFrame) -> DataFrame | None:
    """By time; None if there are fewer than two, as a back-test needs."""
    return found.orderBy("timestamp") if len(found.take(2)) == 2 else None


#: Trade managers of a back-test (fixed values): type, stop and take as multiples of min_points, reward ratio, minutes.
MANAGERS = (
    ("fixed_sl_tp", 1.0, 0.5, None, None),
    ("fixed_sl_tp", 1.0, 1.0, None, None),
    ("risk_reward", 1.0, None, 3.0, None),
    ("time_stop", 1.0, 1.0, None, 240),
)
#: Lot sizers (fixed values): type, risk, lots at first or least, factor, steps, most lots.
SIZERS = (
    ("percentage_risk", 0.02, 0.01, None, None, 1.0),
    ("martingale_lot_size", None, 0.01, 1.5, 5, None),
    ("anti_martingale_lot_size", None, 0.01, 1.5, 5, None),
)


def backtest_grid(points: DataFrame) -> DataFrame:
    """Every manager with every sizer for each symbol's min_points: a literal of twelve entries a row."""
    number = lambda x: F.lit(x).cast("double")
    grid = [
        F.struct(
            F.lit(m).alias("manager"), (F.col("min_points") * number(stop)).alias("stop_points"), (F.col("min_points") * number(take)).alias("take_points"), number(ratio).alias("reward_ratio"),
            F.lit(minutes).cast("int").alias("max_minutes"), F.lit(z).alias("sizer"), number(risk).alias("risk"), number(lots).alias("lots"), number(factor).alias("factor"), F.lit(steps).cast("int").alias("steps"), number(most).alias("max_lots"),
        )
        for m, stop, take, ratio, minutes in MANAGERS for z, risk, lots, factor, steps, most in SIZERS
    ]
    return points.select("symbol", F.explode(F.array(*grid)).alias("g")).select("symbol", "g.*")


def ensemble_entry(components: DataFrame, signal_type: str = "both", match_symbols: bool = True) -> DataFrame:
    """One row an ensemble: mean metrics (0 for the side it doesn't signal), longest window, symbols."""
    metric = lambda n: F.lit(0.0) if signal_type == ("sell_only" if n.endswith("_buy") else "buy_only") else F.avg(F.coalesce(n, F.lit(0.0)))
    names = ("precision_buy", "recall_buy", "precision_sell", "recall_sell")
    out = components.groupBy("ensemble_id").agg(*(metric(n).alias(n) for n in names), F.max("sequence_length").alias("sequence_length"), F.count("*").alias("components"), F.array_sort(F.collect_set("symbol")).alias("symbols"))
    if match_symbols:
        out = out.filter(F.when(F.size("symbols") <= 1, True).otherwise(F.raise_error("Components of an ensemble have different symbols").cast("boolean")))
    return out.withColumn("symbol", F.array_join("symbols", ",")).drop("symbols")
