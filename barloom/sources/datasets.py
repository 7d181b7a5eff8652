"""Versioned data sets of windows: partitioned Parquet and a manifest that finds equal ones again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("source", "group", "symbol", "sequence_length", "version", "split")
MANIFEST = "version long, split string, symbol string, digest string, metadata string, written_at timestamp"


def metadata(bars: DataFrame, **options) -> DataFrame:
    """One row a symbol: first and last time, rows, and the options as sorted JSON."""
    return bars.groupBy("symbol").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("rows")).withColumn("options", F.lit(canonical(options)))


def canonical(options: dict) -> str:
    return json.dumps(options, sort_keys=True, separators=(",", ":"), default=str)


def digest(options: dict) -> str:
    """16 hexadecimal digits that name a set of options."""
    return hashlib.sha256(canonical(options).encode()).hexdigest()[:16]


def next_version(versions: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The version after the largest of all splits."""
    return versions.groupBy(*by).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def matching_version(manifest: DataFrame, wanted: str, splits: tuple[str, ...] = ("train", "eval"), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The newest version whose splits are all there with the wanted digest."""
    found = manifest.filter((F.col("digest") == wanted) & F.col("split").isin(*splits)).groupBy(*by, "version").agg(F.countDistinct("split").alias("k"))
    return found.filter(F.col("k") == len(splits)).groupBy(*by).agg(F.max("version").alias("version"))


class Store:
    """Data sets below a root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def find(self, symbol: str, options: dict, splits: tuple[str, ...] = ("train", "eval")) -> int | None:
        row = matching_version(self.manifest().filter(F.col("symbol") == symbol), digest(options), splits).first()
        return row["version"] if row else None

    def write(self, windows: dict[str, DataFrame], symbol: str, options: dict) -> int:
        """Writes the splits as the next version, unless an equal one is there; its number."""
        version = self.find(symbol, options, tuple(windows))
        if version is not None:
            return version
        row = next_version(self.manifest().filter(F.col("symbol") == symbol)).first()
        version = row["next_version"] if row else 1
        for split, df in windows.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(symbol, version, split))
        entries = self.spark.createDataFrame([(version, s, symbol, digest(options), canonical(options)) for s in windows], "version long, split string, symbol string, digest string, metadata string")
        entries.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return version

    def path(self, symbol: str, version: int, split: str) -> str:
        return f"{self.root}/symbol={symbol}/version={version}/split={split}"

    def read(self, symbol: str, version: int, split: str) -> DataFrame:
        return self.spark.read.parquet(self.path(symbol, version, split))
