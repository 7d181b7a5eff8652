import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import clustering, ensemble, evaluation, statistics, training
from barloom.operators.windows import TimeTarget
from barloom.plans import probes, trainer
from barloom.sources.datasets import Store, digest
from barloom.sources.settings import Settings, Storage, r2_endpoint


def test_labels_and_no_train_metrics(spark):
    df = spark.createDataFrame([(1,), (3,)], "direction int")
    ids = {r["direction"]: r["class_id"] for r in statistics.dense_ids(df, df, "direction").collect()}
    assert ids == {1: 0, 3: 1}
    data = df.join(statistics.dense_ids(df, df, "direction"), "direction").select(F.col("class_id").alias("label"), F.col("class_id").alias("direction"))
    got = evaluation.class_metrics(training.no_train(data)).first()
    assert all(got[k] == 1 for k in ("accuracy", "precision_buy", "precision_sell", "recall_buy", "recall_sell"))
    assert training.no_train(spark.createDataFrame([(None, 1)], "direction int, target int")).first()["predicted"] == 1


def test_min_points_weights_bias(spark):
    df = spark.createDataFrame([("s", 10.0, 15.0)], "symbol string, target_highest double, target_lowest double")
    assert statistics.min_target_points(df).first()["min_points"] == 12
    y = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    weights = {r["label"]: r["weight"] for r in statistics.class_weights(y).collect()}
    assert weights == pytest.approx({0: 2 / 3, 1: 2})
    bias = {r["label"]: r["bias"] for r in statistics.output_bias(y, 3).collect()}
    assert bias[0] == pytest.approx(-0.28768, abs=1e-4) and bias[2] < -80


def test_percentile_by_ranks(spark):
    """Equal to numpy's, ties and all-equal columns included; imputed takes the finite values only."""
    rng = np.random.default_rng(3)
    for values in ([4.0], [1.0, 2.0], [7.0] * 50, list(rng.normal(size=301)), [float(x) for x in rng.integers(0, 5, 200)]):
        df = spark.createDataFrame([(float(x),) for x in values], "x double")
        for share in (0, 0.1, 0.5, 0.95, 1):
            assert statistics.percentile(df, "x", share) == pytest.approx(np.percentile(values, 100 * share), abs=1e-12)
    assert statistics.percentile(spark.createDataFrame([], "x double"), "x", 0.5) is None
    odd = spark.createDataFrame([(1, 3.0), (2, None), (3, float("nan")), (4, float("-inf")), (5, 4.0)], "i int, x double")
    assert [r["x"] for r in statistics.imputed(odd, odd, ("x",)).orderBy("i").collect()] == [3.0, 3.5, 3.5, 3.5, 4.0]
    none = odd.filter("i in (2, 3)")
    assert [r["x"] for r in statistics.imputed(none, none, ("x",)).collect()] == [None, None]


def test_gate_edges(spark):
    schema = "precision_buy double, recall_buy double, precision_sell double, recall_sell double, val_loss double, train_loss double"
    rows = [(0.55, 0.9, 0.0, 0.0, 1.0, 1.0), (0.56, 0.41, 0.0, 0.0, 1.5, 1.25), (0.9, 0.9, 0.9, 0.9, 2.0, 1.0), (None, None, 0.9, 0.9, 1.0, 1.0)]
    got = evaluation.gate(spark.createDataFrame(rows, schema)).collect()
    assert [r["valid"] for r in got] == [False, True, False, True]
    assert got[0]["reason_precision_buy"] == "FAIL: 0.5500 <= 0.5500" and got[1]["reason_gap"] == "PASS: 0.2000 <= 0.2000"
    assert evaluation.gate(spark.createDataFrame([(0.9, 0.9)], "precision_buy double, recall_buy double")).first()["valid"] is True


def brute_vote(votes, rule):
    count = Counter(p for p, _ in votes)
    most = [p for p in count if count[p] == max(count.values())]
    if rule == "unanimous":
        return most[0] if len(count) == 1 else 2
    if len(most) == 1:
        return most[0]
    return 2 if rule == "majority" else min((k, p) for p, k in votes if p in most)[1]


def test_votes(spark):
    rng = random.Random(2)
    votes = {i: [(rng.randrange(3), k) for k in rng.sample(range(1, 9), 4)] for i in range(400)} | {400: [(0, 2), (1, 1)] * 2}
    df = spark.createDataFrame([(i, p, k) for i, v in votes.items() for p, k in v], "row_id int, prediction int, priority int")
    for rule in ("unanimous", "majority", "priority_tiebreak"):
        got = {r["row_id"]: r["prediction"] for r in ensemble.vote(df, rule, components=4).collect()}
        assert got == {i: brute_vote(v, rule) for i, v in votes.items()}
    with pytest.raises(Exception, match="disagree"):
        ensemble.vote(df.filter("not (row_id = 3 and priority > 4)"), "majority", components=4).collect()
    a, b = (spark.createDataFrame(list(enumerate(p)), "row_id int, prediction int") for p in ([0, 1], [1, 0]))
    assert [r["prediction"] for r in ensemble.filter_override(a, b, 1).orderBy("row_id").collect()] == [0, 2]


def test_kmeans_step_keeps_lonely_centroid(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.0, 2.0],), ([10.0, 0.0],)], "vector array<double>")
    got = {r["cluster"]: (r["members"], r["vector"]) for r in clustering.step(df, [(0, [0.0, 1.0]), (1, [9.0, 0.0]), (2, [99.0, 99.0])]).collect()}
    assert got == {0: (2, [0, 1]), 1: (1, [10, 0]), 2: (0, [99, 99])}
    tie = clustering.assign(df, [(5, [1.0, 0.0]), (3, [-1.0, 0.0])]).first()
    assert tie["cluster"] == 3 and clustering.loss(df, [(0, [0.0, 0.0])]).first()["loss"] == pytest.approx(104 / 3)
    assert clustering.fit(df, 2, "randomizer").summary.trainingCost == pytest.approx(2)


def test_sampling(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), [float(i % 7), float(i % 3)]) for i in range(2000)], "id int, label int, vector array<double>")
    for how, want in (("over", 1800), ("downsample", 200), ("both", 1800)):
        got = {r["label"]: r["count"] for r in training.sampled(df, how, keys=("id",)).groupBy("label").count().collect()}
        assert got == {0: want, 1: want}
    assert training.sampled(df, "off") is df and training.sampled(df, "weighted").filter("label = 1").first()["weight"] == 5
    made = {r["label"]: r["count"] for r in training.smote(df.select("label", "vector")).groupBy("label").count().collect()}
    assert made[0] == 1800 and made[1] == pytest.approx(1800, rel=0.1)
    with pytest.raises(ValueError):
        training.sampled(df, "other")
    places = training.place(df, ("id",)).collect()
    assert all(r["place"] == r["id"] for r in places)
    params, score = training.search(df.limit(300), 2, ("id",), trials=1, grid={"maxDepth": (2,), "maxIter": (2,)})
    assert params == {"maxDepth": 2, "maxIter": 2} and score > 0.5


def test_smote_neighbours_of_the_whole_class(spark):
    """New rows lie between a row and one of its five nearest of the class, however the class is dealt in blocks."""
    import numpy as np

    rng = np.random.default_rng(3)
    small = np.concatenate([rng.normal(size=(60, 4)), [[9.0] * 4] * 3])
    rows = [(1, v.tolist()) for v in small] + [(0, v.tolist()) for v in rng.normal(size=(300, 4))] + [(2, [1.0] * 4)]
    df = spark.createDataFrame(rows, "label int, vector array<double>")
    nearest = [[small[j] for j in sorted((j for j in range(len(small)) if j != i), key=lambda j: ((small[j] - small[i]) ** 2).sum())[:5]] for i in range(len(small))]
    for block in (2048, 16):
        made = training.smote(df, block=block).collect()
        one = [np.array(r["vector"]) for r in made if r["label"] == 1]
        assert sum(r["label"] == 0 for r in made) == 300 and len(one) == pytest.approx(300, abs=40)
        assert [r["vector"] for r in made if r["label"] == 2] == [[1.0] * 4] * 300
        on = lambda p, a, b: abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) < 1e-9
        assert all(any(on(p, a, b) for a, near in zip(small, nearest) for b in near) for p in one)
        assert len({tuple(p) for p in one}) > 250


def test_probes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i % 3, [float(i % 3) + rng.random() / 4, rng.random()], float(i % 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, label int, vector array<double>, x double")
    small = {"small": {"maxIter": 5, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0}}
    found, passed = probes.feature_potential(df, presets=small)
    assert passed and found.first()["accuracy"] > 0.95
    assert probes.train_and_evaluate(df, ("id",), presets=small | {"balanced": small["small"]}).count() == 2
    assert probes.net_overfit(df, presets={"n": ((6,), 60, 32)})[1]
    scores = {r["feature"]: r["importance"] for r in probes.feature_importance(df.drop("x"), ("vector",)).collect()}
    assert scores == {"vector": 1}
    probes.write_backtest(spark.createDataFrame([(2, "BUY", 1.0), (1, "SELL", 2.0)], "timestamp long, signal_type string, price double"), str(tmp_path), {"b": 1})
    assert [r["timestamp"] for r in spark.read.option("header", True).csv(f"{tmp_path}/signals").collect()] == ["1", "2"]


def test_store_and_settings(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.range(5)
    a = store.write({"train": df, "eval": df}, "X", {"length": 3})
    assert a == 1 and store.write({"train": df, "eval": df}, "X", {"length": 3}) == 1
    assert store.write({"train": df, "eval": df}, "X", {"length": 4}) == 2 and store.read("X", 2, "eval").count() == 5
    assert store.find("X", {"length": 9}) is None and digest({"b": 1, "a": 2}) == digest({"a": 2, "b": 1}) and len(digest({})) == 16
    with pytest.raises(ValueError):
        Storage("other")
    with pytest.raises(ValueError):
        Storage("minio", "http://host:9001")
    with pytest.raises(ValueError):
        r2_endpoint(" ")
    options = Storage.one_bucket("b", backend="minio", endpoint="http://host:9000", access_key="k").hadoop_options()
    assert options["spark.hadoop.fs.s3a.path.style.access"] == "true" and Storage.one_bucket("b").root("train") == "s3a://b"
    own = Settings.from_env({"SEQUENCE_STRIDE": "7", "SHUFFLE_TRAIN_DATA": "false"})
    assert own.sequence_stride == 7 and own.shuffle_train_data is False and own.eval_min_precision == 0.55


def test_trainer(spark, tmp_path):
    import numpy as np
    from test_indicators import bars_of

    x = 100 + 10 * np.sin(np.arange(900) / 9) + np.random.default_rng(1).normal(0, 0.3, 900)
    bars = bars_of(spark, list(x), list(x + 0.5), list(x - 0.5))
    settings = Settings(sequence_stride=2, min_signals=50, min_sequences=100, eval_min_precision=0.3, eval_min_recall=0.2, max_overfit_gap=50.0)
    store = Store(spark, str(tmp_path))
    plan = trainer.Plan(length=12, target=TimeTarget(5, "points"), tree_params={"maxIter": 8, "maxDepth": 5})
    (made, absent) = trainer.run(spark, bars, ["s", "absent"], plan, settings, store)
    assert made.evaluator_passed and made.signals.count() > 10 and not absent.benchmark_passed and absent.reason
    loaded = trainer.load(store, made.model_id)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i : i + 20]]) for i in range(0, 80, 4)], "row_id int, close array<double>")
    one = trainer.predict(loaded, rows)
    both = trainer.predict_ensemble([(1, loaded), (2, loaded)], rows, "unanimous")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.collect()))
    assert trainer.ranked([absent, made]) == [made]
    known = trainer.run_symbol(bars, "s", trainer.Plan(model_type="no_train", length=12, target=TimeTarget(5, "points")), settings)
    assert known.metrics["accuracy"] == 1 and known.evaluator_passed
    clusters = trainer.run_symbol(bars, "s", trainer.Plan(model_type="clusters", length=12, clusters=4), settings)
    assert clusters.evaluator_passed and clusters.metrics["val_loss"] > 0


def test_votes_of_rows_without_any(spark):
    votes = spark.createDataFrame([(1, 0, 1), (2, None, 1), (3, 7, 1)], "row_id int, prediction int, priority int")
    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4)], "row_id int")
    for rule in ("unanimous", "majority", "priority_tiebreak"):
        got = sorted(map(tuple, ensemble.vote(votes, rule, rows_of=rows).collect()))
        assert got == [(1, 0), (2, 2), (3, 2), (4, 2)]


def test_sampling_of_the_environment(spark, monkeypatch):
    assert training.sampling_from_env({}) == "weights"
    assert training.sampling_from_env({"DATA_SAMPLING_STRATEGY": "both", "SAMPLING_STRATEGY": " Up "}) == "over"
    assert training.sampling_from_env({"TRAIN_DATA_SAMPLING": "off", "SAMPLING_STRATEGY": "up"}) == "none"
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "id int, label int")
    monkeypatch.setattr(training, "sampling_from_env", lambda: "weights")
    assert {(r["label"], r["weight"]) for r in training.resampled(df).collect()} == {(0, 40 / 60), (1, 2.0)}
    assert {(r["weight"], r["count"]) for r in training.resampled(df, "under", keys=("id",)).groupBy("label", "weight").count().collect()} == {(1.0, 10)}
    assert {r["weight"] for r in training.resampled(df, "none").collect()} == {1.0}


def test_symbol_properties(spark, tmp_path):
    import json

    from barloom.sources import properties

    whole = {"symbol": "EURUSD", "source": "mt5", "group": "fx", "contract_size": 100000, "point_size": 1e-5, "digits": 5, "data_start": "2020-01-01"}
    path = properties.properties_path(str(tmp_path), "mt5", "fx", "EURUSD")
    (tmp_path / "mt5" / "fx" / "EURUSD").mkdir(parents=True)
    with open(path, "w") as f:
        json.dump(whole, f, indent=2)
    got = properties.read(spark, str(tmp_path), "mt5", "fx", "EURUSD")
    assert got.first().asDict() == whole | {"data_end": None}
    bars = spark.createDataFrame([("EURUSD", 1), ("GBPUSD", 2)], "symbol string, time int")
    assert properties.with_point(bars.filter("time = 1"), got).first()["point_size"] == 1e-5
    with pytest.raises(Exception, match="No properties of GBPUSD"):
        properties.with_point(bars, got).collect()
    for name in ("contract_size", "digits", "symbol"):
        for value in (None, ""):
            text = json.dumps(whole | {name: value})
            with pytest.raises(Exception, match=f"without a valid {name}"):
                properties.parsed(spark.createDataFrame([(text,)], "value string")).collect()
