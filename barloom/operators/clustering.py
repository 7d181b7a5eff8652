"""k-means steps over vectors in array columns, and fits by Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centroid values that a broadcast may hold; more are joined by a shuffle.
BROADCAST_VALUES = 1 << 20


def _distance(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign(points: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "vector") -> DataFrame:
    """Adds cluster and distance (squared) of the nearest centroid; ties go to the least id.

    The centroids are a literal that every row is compared with: their number is a parameter
    of the model, checked against BROADCAST_VALUES, and no row is copied.
    """
    if sum(len(v) for _, v in centroids) > BROADCAST_VALUES:
        raise ValueError("Too many centroid values")
    spark = points.sparkSession
    table = spark.createDataFrame([(sorted(centroids),)], "__c array<struct<id:int,v:array<double>>>")
    near = F.array_min(F.transform("__c", lambda c: F.struct(_distance(F.col(vector), c["v"]).alias("d"), c["id"].alias("id"))))
    rows = points.crossJoin(F.broadcast(table)).withColumn("__n", near)
    return rows.withColumns({"cluster": F.col("__n.id"), "distance": F.col("__n.d")}).drop("__c", "__n")


def step(points: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "vector") -> DataFrame:
    """One row a centroid: cluster, members, and its new vector; one without members keeps the old."""
    spark, size = points.sparkSession, len(centroids[0][1])
    found = assign(points, centroids, vector)
    means = found.groupBy("cluster").agg(F.count("*").alias("members"), F.array(*(F.avg(F.get(vector, F.lit(i))) for i in range(size))).alias("mean"))
    old = spark.createDataFrame([(i, v) for i, v in centroids], "cluster int, old array<double>")
    return old.join(means, "cluster", "left").select("cluster", F.coalesce("members", F.lit(0)).cast("long").alias("members"), F.coalesce("mean", "old").alias("vector"))


def loss(points: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "vector") -> DataFrame:
    return assign(points, centroids, vector).agg(F.avg("distance").alias("loss"))


def default_clusters(rows: int) -> int:
    return min(500, rows)


def _vectors(points: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return points.withColumn("features", array_to_vector(F.col(vector)))


def fit(points: DataFrame, clusters: int, mode: str = "kplus", epochs: int = 20, seed: int = 44, trials: int = 3, vector: str = "vector"):
    """A KMeansModel. mode kplus: parallel k-means++ start; randomizer: the best of `trials` random starts."""
    from pyspark.ml.clustering import KMeans

    data = _vectors(points, vector)
    if mode == "kplus":
        return KMeans(k=clusters, maxIter=epochs, seed=seed).fit(data)
    if mode != "randomizer":
        raise ValueError(f"Unknown mode: {mode}")
    tried = [KMeans(k=clusters, maxIter=epochs, seed=seed + i, initMode="random").fit(data) for i in range(trials)]
    return min(tried, key=lambda m: m.summary.trainingCost)


def predict(model, points: DataFrame, vector: str = "vector") -> DataFrame:
    return model.transform(_vectors(points, vector)).drop("features")
