"""Runs over symbols: data set, labels, model, gates, artifact and signals.

The loop over symbols is the driver's; all rows stay in DataFrames. One symbol's failure
is its own result and doesn't end the run.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import clustering, ensemble, evaluation, statistics, training, windows
from barloom.sources.datasets import Store, canonical
from barloom.sources.settings import Settings

LOGGER = logging.getLogger(__name__)


@dataclass
class Result:
    symbol: str
    model_type: str
    benchmark_passed: bool = False
    evaluator_passed: bool = False
    metrics: dict = field(default_factory=dict)
    model_id: str | None = None
    reason: str = ""
    signals: DataFrame | None = None


@dataclass
class Plan:
    """What a run does. preprocess adds `vector` (and may add `label`) to windows with targets."""

    model_type: str = "trees"  # trees, no_train or clusters
    length: int = 24
    target: windows.TimeTarget = windows.TimeTarget(6, "points")
    point: float | None = 0.1  # None: each symbol's own, from bars that have point_size
    percentile: int = 50
    features: tuple[str, ...] = ("close",)
    preprocess: object = None
    clusters: int | None = None
    tree_params: dict = field(default_factory=dict)
    sampling: str | None = None  # what the environment names, else weights


def _features(df: DataFrame, plan: Plan) -> DataFrame:
    return plan.preprocess(df) if plan.preprocess else windows.stacked(df, plan.features)


def run_symbol(bars: DataFrame, symbol: str, plan: Plan, settings: Settings, store: Store | None = None) -> Result:
    """One symbol; bars may hold more symbols."""
    result = Result(symbol, plan.model_type)
    own = bars.filter(F.col("symbol") == symbol)
    try:
        if plan.model_type == "clusters":
            return _clusters(own, plan, settings, result, store)
        made = windows.windows(own, plan.length, settings.sequence_stride, target=plan.target, point=F.col("point_size") if plan.point is None else plan.point)
        if store:
            options = {"symbol": symbol, "length": plan.length, "stride": settings.sequence_stride, "target": vars(plan.target), "point": plan.point}
            version = store.write({"train": made}, symbol, options)
            made = store.read(symbol, version, "train")
        least = statistics.min_target_points(made, plan.percentile)
        data = _features(statistics.labelled(made.join(least, "symbol")), plan)
        data = windows.without_class(data, "label", settings.exclude_class_id)
        fit = statistics.eligibility(data, ("entry",), min_signals=settings.min_signals, min_sequences=settings.min_sequences, max_ratio=settings.max_imbalance_ratio).first()
        result.benchmark_passed, result.reason = bool(fit and fit["eligible"]), fit["reason"] if fit else "no windows"
        if not result.benchmark_passed:
            return result
        split = training.ordered_split(data, ("rn",))
        train, held = split.filter("not validation"), split.filter("validation")
        if plan.model_type == "no_train":
            model, predicted = None, training.no_train(held.withColumn("direction", F.col("label")))
        else:
            model = training.fit_trees(training.resampled(train, plan.sampling, keys=("symbol", "rn")), 3, weight="weight", **plan.tree_params)
            predicted = training.predict(model, held)
        scores = evaluation.class_metrics(predicted, ("symbol",))
        losses = {"val_loss": F.lit(0.0), "train_loss": F.lit(0.0)} if model is None else {"val_loss": F.lit(training.log_loss(model, held)), "train_loss": F.lit(training.log_loss(model, train))}
        gated = evaluation.gate(scores.withColumns(losses), settings.eval_min_precision, settings.eval_min_recall, settings.max_overfit_gap)
        row = gated.first()
        result.metrics, result.evaluator_passed = row.asDict(), bool(row["valid"])
        if result.evaluator_passed:
            result.model_id = str(uuid.uuid4())
            if store and model is not None:
                save(store, model, result, plan)
            result.signals = ensemble.signals(predicted.withColumnRenamed("predicted", "prediction"), gated)
    except Exception as e:  # the other symbols go on
        LOGGER.exception("%s failed", symbol)
        result.reason = f"{type(e).__name__}: {e}"
    return result


def _clusters(own: DataFrame, plan: Plan, settings: Settings, result: Result, store: Store | None) -> Result:
    made = _features(windows.windows(own, plan.length, settings.sequence_stride), plan).cache()
    rows = made.count()
    model = clustering.fit(made, plan.clusters or clustering.default_clusters(rows))
    result.metrics = {"accuracy": 0.0, "precision_buy": 0.0, "precision_sell": 0.0, "recall_buy": 0.0, "recall_sell": 0.0, "train_loss": 0.0, "val_loss": model.summary.trainingCost / max(1, rows)}
    result.benchmark_passed = result.evaluator_passed = True
    result.model_id = str(uuid.uuid4())
    if store:
        save(store, model, result, plan)
    made.unpersist()
    return result


def save(store: Store, model, result: Result, plan: Plan, filter_id: str | None = None, filter_class: int | None = None) -> str:
    """The model and a row of metadata below prediction-models/{id}."""
    if (filter_id is None) != (filter_class is None):
        raise ValueError("A filter needs both its id and its class")
    root = f"{store.root}/prediction-models/{result.model_id}"
    model.write().overwrite().save(f"{root}/model")
    entry = {
        "model_kind": "single", "model_id": result.model_id, "symbol": result.symbol, "model_type": result.model_type, "sequence_length": plan.length, "feature_keys": sorted(plan.features),
        "metrics": {k: v for k, v in result.metrics.items() if isinstance(v, (int, float))}, "benchmark_passed": result.benchmark_passed, "filter_model_id": filter_id, "filter_class": filter_class, "model_class": type(model).__name__,
    }
    store.spark.createDataFrame([(canonical(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/properties")
    return root


def load(store: Store, model_id: str, depth: int = 4) -> dict:
    """Metadata, model and, as `filter`, the model that filters it; at most `depth` of them in a row."""
    import json

    from pyspark.ml import classification, clustering as ml_clustering

    if depth < 1:
        raise ValueError("Too many filters in a row")
    root = f"{store.root}/prediction-models/{model_id}"
    entry = json.loads(store.spark.read.text(f"{root}/properties").first()[0])
    kind = getattr(classification, entry["model_class"], None) or getattr(ml_clustering, entry["model_class"])
    out = {"properties": entry, "model": kind.load(f"{root}/model")}
    if entry["filter_model_id"]:
        out["filter"] = load(store, entry["filter_model_id"], depth - 1)
    return out


def predict(loaded: dict, df: DataFrame, row: str = "row_id") -> DataFrame:
    """row and prediction of one loaded model over tail-cut windows, its filter applied."""
    entry = loaded["properties"]
    own = windows.stacked(windows.tail(df, entry["sequence_length"]), tuple(entry["feature_keys"]))
    found = training.predict(loaded["model"], own).select(row, F.col("predicted").alias("prediction"))
    if "filter" in loaded:
        found = ensemble.filter_override(found, predict(loaded["filter"], df, row), entry["filter_class"], row)
    return found


def predict_ensemble(loaded: list[tuple[int, dict]], df: DataFrame, rule: str, row: str = "row_id") -> DataFrame:
    """The vote of several loaded models, each with its priority."""
    from functools import reduce

    each = [predict(m, df, row).withColumn("priority", F.lit(p)) for p, m in loaded]
    return ensemble.vote(reduce(DataFrame.unionByName, each), rule, row, len(each))


def run(spark: SparkSession, bars: DataFrame, symbols: list[str], plan: Plan, settings: Settings | None = None, store: Store | None = None) -> list[Result]:
    """One result a symbol, in order; those that passed come first by their scores in `ranked`."""
    return [run_symbol(bars, s, plan, settings or Settings(), store) for s in symbols]


def ranked(results: list[Result]) -> list[Result]:
    keys = ("precision_buy", "recall_buy", "precision_sell", "recall_sell")
    return sorted((r for r in results if r.evaluator_passed), key=lambda r: tuple(r.metrics.get(k, 0.0) for k in keys), reverse=True)
