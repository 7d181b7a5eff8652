"""Probes of a feature set before it is trusted: can any model learn it, and which features tell classes apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import evaluation, statistics, training


def train_and_evaluate(data: DataFrame, order: tuple[str, ...], classes: int = 3, presets: dict | None = None, label: str = "label") -> DataFrame:
    """One row of held-out metrics a preset, over the ordered split."""
    split = training.ordered_split(data, order)
    train, held = split.filter("not validation"), split.filter("validation")
    rows = []
    for name, params in (presets or {k: v for k, v in training.TREES.items() if k != "default"}).items():
        weighted = name == "balanced"
        own = training.sampled(train, "weights", label) if weighted else train
        model = training.fit_trees(own, classes, label, weight="weight" if weighted else None, **params)
        rows.append(evaluation.class_metrics(training.predict(model, held), hold=classes > 2, label=label).withColumn("preset", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)


def feature_potential(data: DataFrame, classes: int = 3, presets: dict | None = None, label: str = "label") -> tuple[DataFrame, bool]:
    """Metrics on the training data itself for each preset, and whether any reaches the gate."""
    rows = []
    for name, params in (presets or training.OVERFIT_TREES).items():
        model = training.fit_trees(data, classes, label, **params)
        rows.append(evaluation.class_metrics(training.predict(model, data), hold=classes > 2, label=label).withColumn("preset", F.lit(name)))
    found = reduce(DataFrame.unionByName, rows)
    gate = evaluation.overfit_probe(found.withColumn("symbol", F.lit("all"))).first()
    return found, bool(gate["scores_pass"])


def net_overfit(data: DataFrame, classes: int = 3, presets: dict | None = None, label: str = "label", vector: str = "vector") -> tuple[DataFrame, bool]:
    """The same for dense nets over z-scored features; the gate is the accuracy."""
    size = len(data.select(vector).head(1)[0][0])
    stats = data.agg(*(f(F.get(vector, F.lit(i))).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = data.withColumn(vector, F.array(*((F.get(vector, F.lit(i)) - stats[f"m{i}"]) / (stats[f"s{i}"] + 1e-8) for i in range(size))))
    rows = []
    for name, (layers, steps, block) in (presets or training.OVERFIT_NETS).items():
        model = training.fit_dense(scaled, layers, classes, label, vector, steps, block)
        rows.append(evaluation.class_metrics(training.predict(model, scaled, vector), hold=classes > 2, label=label).withColumn("preset", F.lit(name)))
    found = reduce(DataFrame.unionByName, rows)
    return found, bool(evaluation.overfit_probe(found.withColumn("symbol", F.lit("all"))).first()["accuracy_pass"])


def feature_importance(data: DataFrame, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """ANOVA F of array or scalar features: the mean over an array's places, by the largest."""
    kinds, parts = dict(data.dtypes), {}
    for c in features:
        if kinds[c].startswith("array"):
            parts[c] = [F.get(c, F.lit(i)).alias(f"{c}__{i}") for i in range(len(data.select(c).head(1)[0][0]))]
        else:
            parts[c] = [F.col(c).alias(f"{c}__0")]
    flat = data.select(label, *(x for p in parts.values() for x in p))
    scores = statistics.anova_f(flat, tuple(c for c in flat.columns if c != label), label)
    mean = scores.groupBy(F.regexp_replace("feature", "__[0-9]+$", "").alias("feature")).agg(F.avg("f").alias("f"))
    top = mean.agg(F.max("f").alias("__top"))
    return mean.crossJoin(F.broadcast(top)).select("feature", "f", (F.col("f") / F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)).alias("importance"))


def write_backtest(signals: DataFrame, path: str, config: dict) -> None:
    """Signals as CSV in order of time and the configuration as JSON, for an outside back-test."""
    from barloom.sources.datasets import canonical

    signals.orderBy("timestamp").write.mode("overwrite").option("header", True).csv(f"{path}/signals")
    signals.sparkSession.createDataFrame([(canonical(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
