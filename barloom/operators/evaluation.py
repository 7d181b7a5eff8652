"""Scores of predictions and the gates they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {0: "buy", 1: "sell", 2: "hold"}
#: Gates of a model (fixed values): precision and recall must exceed, the loss gap may reach.
MIN_PRECISION, MIN_RECALL, MAX_GAP = 0.55, 0.4, 0.2


def confusion(df: DataFrame, classes: int = 3, label: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows are true classes, columns pred_0, pred_1, ..."""
    return df.groupBy(*by, label).agg(*(F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in range(classes)))


def class_metrics(df: DataFrame, by: tuple[str, ...] = (), epsilon: float = 0.0, hold: bool = False, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """accuracy, and precision, recall and f1 of each class; 0 where there is nothing to divide by.

    With epsilon, it is added to every divisor instead.
    """
    y, p = F.col(label), F.col(predicted)
    classes = [0, 1, 2] if hold else [0, 1]
    counts = df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(y == p).alias("right"),
        *(f.alias(f"{n}_{c}") for c in classes for n, f in (("tp", F.count_if((y == c) & (p == c))), ("pp", F.count_if(p == c)), ("yy", F.count_if(y == c)))),
    )
    ratio = (lambda a, b: a / (b + epsilon)) if epsilon else (lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    out = [ratio(F.col("right"), F.col("rows")).alias("accuracy")]
    for c in classes:
        precision, recall = ratio(F.col(f"tp_{c}"), F.col(f"pp_{c}")), ratio(F.col(f"tp_{c}"), F.col(f"yy_{c}"))
        f1 = ratio(2 * precision * recall, precision + recall)
        out += [precision.alias(f"precision_{NAMES[c]}"), recall.alias(f"recall_{NAMES[c]}"), f1.alias(f"f1_{NAMES[c]}")]
    return counts.select(*by, *out)


def macro(metrics: DataFrame, classes: tuple[str, ...] = ("buy", "sell", "hold")) -> DataFrame:
    """Means over the classes of class_metrics(hold=True)."""
    mean = lambda n: sum(F.col(f"{n}_{c}") for c in classes) / len(classes)
    return metrics.withColumns({f"macro_{n}": mean(n) for n in ("precision", "recall", "f1")})


def gate(metrics: DataFrame, min_precision: float = MIN_PRECISION, min_recall: float = MIN_RECALL, max_gap: float = MAX_GAP) -> DataFrame:
    """Adds buy_valid, sell_valid, gap, gap_valid, valid and a reason for each check; missing metrics fail."""
    value = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in metrics.columns else F.lit(d)
    val, train = value("val_loss", 1e9), value("train_loss", 1e9)
    gap = F.abs(val - train) / F.greatest(F.abs(train), F.lit(1e-8))
    df = metrics.withColumn("gap", gap)
    passed, reasons = {}, {}
    for side in ("buy", "sell"):
        for name, least in (("precision", min_precision), ("recall", min_recall)):
            own = value(f"{name}_{side}", 0.0)
            passed[name, side] = own > least
            reasons[f"reason_{name}_{side}"] = F.when(own > least, F.format_string("PASS: %.4f > %.4f", own, F.lit(least))).otherwise(F.format_string("FAIL: %.4f <= %.4f", own, F.lit(least)))
    buy, sell = (passed["precision", s] & passed["recall", s] for s in ("buy", "sell"))
    small = F.col("gap") <= max_gap
    reasons["reason_gap"] = F.when(small, F.format_string("PASS: %.4f <= %.4f", "gap", F.lit(max_gap))).otherwise(F.format_string("FAIL: %.4f > %.4f", "gap", F.lit(max_gap)))
    return df.withColumns({"buy_valid": buy, "sell_valid": sell, "gap_valid": small, "valid": (buy | sell) & small, **reasons})


def overfit_probe(metrics: DataFrame, by: tuple[str, ...] = ("symbol",), least: float = 0.8, least_accuracy: float = 0.9) -> DataFrame:
    """Whether any configuration could learn its training data: all classes' scores, or the accuracy."""
    scores = [c for c in metrics.columns if c.startswith(("precision_", "recall_"))]
    all_high = F.array_min(F.array(*scores)) >= least
    return metrics.groupBy(*by).agg(F.bool_or(all_high).alias("scores_pass"), F.bool_or(F.col("accuracy") >= least_accuracy).alias("accuracy_pass"))


def rank_models(metrics: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Passing models by precision and recall, both sides, best first; rank 1 is the best."""
    from pyspark.sql import Window

    keys = [F.desc(c) for c in ("precision_buy", "recall_buy", "precision_sell", "recall_sell")]
    order = Window.partitionBy(*by).orderBy(*keys, "model_id")
    return metrics.filter("valid").withColumn("rank", F.row_number().over(order))
