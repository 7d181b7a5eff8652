"""Splits, class sampling and tree models. Boosted trees stand in for an outside library: not numerically equal."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 44
#: Names of class sampling (fixed values); the first of each is what sampled() compares with.
SAMPLINGS = (
    ("none", "off", "false", "0"),
    ("weights", "class_weight", "class_weights", "weighted"),
    ("over", "oversample", "upsample", "up"),
    ("under", "undersample", "downsample", "down"),
    ("over_under", "upsample_undersample", "both"),
    ("smote", "smote_over"),
    ("smote_under", "smote_undersample"),
)
#: Presets of tree models (fixed values): trees, depth, step and the share of rows a tree sees.
TREES = {
    "default": {"maxIter": 50, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8},
    "baseline": {"maxIter": 400, "maxDepth": 6, "stepSize": 0.10, "subsamplingRate": 0.80},
    "balanced": {"maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.80},
    "deep_reg": {"maxIter": 800, "maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 0.70},
}
#: Presets that should learn their training data by heart (fixed values).
OVERFIT_TREES = {
    "deep_dense": {"maxIter": 800, "maxDepth": 12, "stepSize": 0.3, "subsamplingRate": 1.0},
    "shallow_many_trees": {"maxIter": 2000, "maxDepth": 6, "stepSize": 0.5, "subsamplingRate": 1.0},
    "extreme_depth": {"maxIter": 500, "maxDepth": 20, "stepSize": 0.2, "subsamplingRate": 1.0},
    "high_lr_no_reg": {"maxIter": 1000, "maxDepth": 10, "stepSize": 0.8, "subsamplingRate": 0.9},
}
#: Layers, steps and rows a step of dense nets of the same purpose (fixed values).
OVERFIT_NETS = {
    "wide_shallow": ((512, 512), 500, 16),
    "deep_narrow": ((256, 256, 256, 256, 128), 600, 8),
    "massive_overfit": ((1024, 1024, 512, 256), 600, 16),
    "leaky_deep": ((512, 256, 256, 128, 128, 64), 600, 8),
    "tiny_batch_brute": ((256, 128, 128, 64), 1000, 4),
}
GRID = {"maxDepth": (3, 6), "stepSize": (0.05, 0.2), "subsamplingRate": (0.7, 1.0)}


def ordered_split(df: DataFrame, order: tuple[str, ...], fraction: float = 0.2) -> DataFrame:
    """Adds boolean `validation`: the last part by `order`. Ranks are counted in ranges, not in one task."""
    total = df.count()
    first = total - int(total * fraction)
    return place(df, order).withColumn("validation", F.col("place") >= first).drop("place")


def place(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds `place`, the 0-based rank over all rows; the first of `order` is a number.

    Ranges of that number of about equal counts are ranked for themselves, and the counts
    of the ranges before are added: no task sees all rows. The bounds are constants of the
    plan, so that counts and ranks agree wherever they are computed.
    """
    from pyspark.ml.feature import Bucketizer

    first = F.col(order[0]).cast("double")
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or [0.0]
    splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
    own = df.withColumn("__first", F.coalesce(first, F.lit(-float("inf"))))  # nulls come first in order, too
    own = Bucketizer(splits=splits, inputCol="__first", outputCol="__part").transform(own).drop("__first")  # by binary search
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__first"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return own.join(F.broadcast(starts), "__part").withColumn("place", F.col("__first") + rank).select(*df.columns, "place")


def sampling_name(name: str) -> str:
    own = name.strip().lower().replace("-", "_")
    for names in SAMPLINGS:
        if own in names:
            return names[0]
    raise ValueError(f"Unknown sampling: {name}; known: {', '.join(n[0] for n in SAMPLINGS)}")


#: Environment names of the sampling, the first that is set counts (fixed values).
SAMPLING_NAMES = ("TRAIN_DATA_SAMPLING", "SAMPLING_STRATEGY", "DATA_SAMPLING_STRATEGY")


def sampling_from_env(env=os.environ) -> str:
    return sampling_name(next(filter(None, map(env.get, SAMPLING_NAMES)), "weights"))


CELL = 4096  # rows that one task ranks


def resampled(df: DataFrame, sampling: str | None = None, label: str = "label", keys: tuple[str, ...] = (), vector: str = "vector") -> DataFrame:
    """sampled() rows with `weight`: all rows by the classes' sizes after sampling, 1 without any sampling.

    sampling: None for what the environment names, and weights if it names none.
    """
    kind = sampling_from_env() if sampling is None else sampling_name(sampling)
    own = df if kind in ("none", "weights") else sampled(df, kind, label, keys, vector=vector)
    return own.withColumn("weight", F.lit(1.0)) if kind == "none" else sampled(own, "weights", label)


def sampled(df: DataFrame, sampling: str, label: str = "label", keys: tuple[str, ...] = (), seed: int = SEED, vector: str = "vector") -> DataFrame:
    """Rows in other shares of the classes. over: repeat up to the largest class; under: pick down to the least.

    Sizes come out exactly. Who is repeated or picked goes by the order of the MD5 of the seed and
    the JSON of `keys` (all columns, if none are named), so reruns agree, and so does any other
    engine; ranks by it are counted in cells of about CELL rows, ranges of the MD5, and
    added up, so that no task sees a whole class. weights adds `weight`; the smote forms return
    label and vector only; after a sampling up, one down changes nothing more.
    """
    kind = sampling_name(sampling)
    if kind == "none":
        return df
    if kind.startswith("smote"):
        return smote(df, label, vector, seed=seed)
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    all_ = Window.partitionBy()
    counts = counts.select(label, "__n", F.max("__n").over(all_).alias("__most"), F.min("__n").over(all_).alias("__least"), F.count("*").over(all_).alias("__k"), F.sum("__n").over(all_).alias("__all"))
    rows = df.join(F.broadcast(counts), label)  # a row a class
    names = df.columns
    if kind == "weights":
        return rows.select(*names, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    want = F.col("__least") if kind == "under" else F.col("__most")
    more = want % F.col("__n")  # rows that come once more than the others
    rows = rows.withColumn("__h", F.md5(F.concat(F.lit(str(seed)), F.to_json(F.struct(*(F.col(c) for c in keys or names)))).cast("binary")))
    share = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") / float(1 << 32)
    rows = rows.withColumn("__cell", F.floor(share * F.ceil(F.col("__n") / CELL)))
    sizes = rows.groupBy(label, "__cell").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(label).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(label).alias("__label"), F.col("__cell").alias("__c"), F.coalesce(before, F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(label, "__cell").orderBy("__h", *(keys or names))) - 1
    rows = rows.join(sizes, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__cell") == F.col("__c")))
    copies = F.floor(want / F.col("__n")).cast("int") + (F.col("__first") + rank < more).cast("int")
    return rows.withColumn("__copies", copies).filter("__copies > 0").select(*names, F.explode(F.sequence(F.lit(1), "__copies")).alias("__i")).drop("__i")


SMOTE_BLOCK = 2048  # distinct vectors of a class on either side of one task's comparison


def smote(df: DataFrame, label: str = "label", vector: str = "vector", neighbours: int = 5, seed: int = SEED, block: int = SMOTE_BLOCK) -> DataFrame:
    """label and vector of df's rows and of new ones between neighbours, until classes are equal in expectation.

    Neighbours are the exact nearest of the whole class, by squared distance and then by the
    vector; copies count as neighbours at distance 0. Each class's distinct vectors are dealt
    in blocks, every block of those that get new rows meets every block of the class in a task
    of its own, and the nearest of each task are merged. The work is quadratic in a class's
    distinct vectors, of which the largest class needs none. A vector without others in its
    class is repeated.
    """
    import numpy as np
    import pandas as pd

    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__want", F.max("__n").over(Window.partitionBy()) / F.col("__n") - 1)
    chance = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), *salt, "__v"), F.lit(1 << 52)) / float(1 << 52)
    own = df.select(F.col(label).alias("__l"), F.col(vector).alias("__v")).groupBy("__l", "__v").agg(F.count("*").alias("__c"))
    own = own.join(F.broadcast(counts.withColumnRenamed(label, "__l")), "__l")  # a row a class
    own = own.withColumn("__new", F.floor(F.col("__c") * F.col("__want") + chance(F.lit("new"))))
    blocks = F.ceil(F.col("__n") / block)
    own = own.withColumns({"__b": F.pmod(F.xxhash64("__v"), blocks), "__all": F.sequence(F.lit(0).cast("long"), blocks - 1)})
    asked = own.filter("__new > 0").select("__l", "__v", F.col("__b").alias("__i"), F.explode("__all").alias("__j"), F.lit(0).alias("__side"), "__c", "__new")
    there = own.filter("__want > 0").select("__l", "__v", F.explode("__all").alias("__i"), F.col("__b").alias("__j"), F.lit(1).alias("__side"), "__c", "__new")

    def near(pdf):
        pdf = pdf.sort_values("__side", kind="stable")
        cut = int((pdf["__side"] == 0).sum())
        found = [[] for _ in range(cut)]
        if 0 < cut < len(pdf):
            x = np.stack(pdf["__v"].to_numpy())
            q, x, copies = x[:cut], x[cut:], pdf["__c"].to_numpy()[cut:]
            order = np.lexsort(x.T[::-1])
            x, copies = x[order], copies[order]
            for i in range(cut):
                d = ((x - q[i]) ** 2).sum(1)
                d[(x == q[i]).all(1)] = np.inf  # itself
                k = min(neighbours, len(x)) - 1
                least = np.flatnonzero(d <= np.partition(d, k)[k])
                least = least[np.argsort(d[least], kind="stable")][:neighbours]
                found[i] = [{"d": float(d[j]), "v": x[j], "c": int(copies[j])} for j in least if d[j] < np.inf]
        return pd.DataFrame({"__l": pdf["__l"].iloc[:cut], "__v": pdf["__v"].iloc[:cut], "__c": pdf["__c"].iloc[:cut], "__new": pdf["__new"].iloc[:cut], "__near": found})

    kind = df.schema[vector].dataType.simpleString()
    shape = f"__l {df.schema[label].dataType.simpleString()}, __v {kind}, __c long, __new long, __near array<struct<d:double,v:{kind},c:long>>"
    found = asked.unionByName(there).groupBy("__l", "__i", "__j").applyInPandas(near, shape)
    found = found.groupBy("__l", "__v", "__c", "__new").agg(F.slice(F.array_sort(F.flatten(F.collect_list("__near"))), 1, neighbours).alias("__near"))
    # the places of the nearest: copies of the vector itself, then the others with theirs
    places = lambda v, c: F.array_repeat(v, F.least(c, F.lit(neighbours)).cast("int"))
    places = F.slice(F.concat(places(F.col("__v"), F.col("__c") - 1), F.flatten(F.transform("__near", lambda e: places(e["v"], e["c"])))), 1, neighbours)
    made = found.withColumn("__near", places).select("__l", "__v", "__near", F.explode(F.sequence(F.lit(1).cast("long"), "__new")).alias("__k"))
    made = made.withColumn("__to", F.coalesce(F.get("__near", F.floor(chance(F.lit("to"), "__k") * F.size("__near")).cast("int")), "__v")).withColumn("__gap", chance(F.lit("gap"), "__k"))
    between = F.zip_with("__v", "__to", lambda a, b: a + F.col("__gap") * (b - a)).cast(kind)
    return df.select(label, vector).unionByName(made.select(F.col("__l").alias(label), between.alias(vector)))


def fit_trees(train: DataFrame, classes: int, label: str = "label", vector: str = "vector", weight: str | None = None, seed: int = SEED, **params):
    """A boosted binary classifier for two classes, a random forest for more."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = train.withColumn("features", array_to_vector(F.col(vector)))
    more = {"weightCol": weight} if weight else {}
    params = TREES["default"] | params
    if classes <= 2:
        return GBTClassifier(labelCol=label, seed=seed, **params, **more).fit(data)
    return RandomForestClassifier(labelCol=label, seed=seed, maxDepth=params["maxDepth"], numTrees=params["maxIter"], subsamplingRate=params["subsamplingRate"], **more).fit(data)


def fit_dense(train: DataFrame, layers: tuple[int, ...], classes: int, label: str = "label", vector: str = "vector", steps: int = 100, block: int = 128, seed: int = SEED):
    """A multilayer perceptron in the role of a dense net; sigmoid layers, L-BFGS."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    size = len(train.select(vector).head(1)[0][0])
    data = train.withColumn("features", array_to_vector(F.col(vector)))
    return MultilayerPerceptronClassifier(labelCol=label, layers=[size, *layers, classes], maxIter=steps, blockSize=block, seed=seed).fit(data)


def predict(model, df: DataFrame, vector: str = "vector") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    out = model.transform(df.withColumn("features", array_to_vector(F.col(vector))))
    return out.select(*df.columns, F.col("prediction").cast("int").alias("predicted"))


def log_loss(model, df: DataFrame, label: str = "label", vector: str = "vector") -> float:
    """Mean of -ln of the true class's probability, at least 1e-7; 0 for an empty table."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(df.withColumn("features", array_to_vector(F.col(vector))))
    own = F.coalesce(F.get(vector_to_array("probability"), F.col(label).cast("int")), F.lit(0.0))
    return out.agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-7))))).first()[0] or 0.0


def search(df: DataFrame, classes: int, order: tuple[str, ...], label: str = "label", vector: str = "vector", trials: int = 30, grid: dict | None = None):
    """The best parameters on the ordered split's last fifth, by accuracy, and their score."""
    split = ordered_split(df, order).cache()
    train, held = split.filter("not validation"), split.filter("validation")
    grid = grid or GRID
    best = (-1.0, {})
    for values in itertools.islice(itertools.product(*grid.values()), trials):
        params = dict(zip(grid, values))
        scored = predict(fit_trees(train, classes, label, vector, **params), held, vector)
        right = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] or 0.0
        best = max(best, (right, params), key=lambda b: b[0])
    split.unpersist()
    return best[1], best[0]


def no_train(df: DataFrame) -> DataFrame:
    """A model that says what the preprocessor says: `direction`, or else `target`."""
    columns = [c for c in ("direction", "target") if c in df.columns]
    if not columns:
        raise ValueError("Neither direction nor target is there")
    return df.withColumn("predicted", F.coalesce(*columns).cast("int"))


def user_model(df: DataFrame, function, schema: str) -> DataFrame:
    """A model from outside (a net, say): function maps an iterator of pandas frames."""
    return df.mapInPandas(function, schema)
