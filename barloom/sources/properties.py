"""Properties of symbols: one JSON object a symbol beside its bars, and one checked row in a table here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import raw_path

#: Names and types of a property file; those of OPTIONAL may be null or left out.
SCHEMA = "symbol string, source string, `group` string, contract_size int, point_size double, digits int, data_start string, data_end string"
NEEDED, OPTIONAL = ("symbol", "source", "group", "contract_size", "point_size", "digits"), ("data_start", "data_end")


def properties_path(root: str, source: str, group: str, symbol: str) -> str:
    return raw_path(root, source, group, symbol).rsplit("/", 1)[0] + "/properties.json"


def parsed(texts: DataFrame, column: str = "value") -> DataFrame:
    """The table of JSON texts, one a row; a text without a needed value, or with one of another kind, is an error."""
    one = texts.select(F.col(column).alias("__text"), F.from_json(column, SCHEMA).alias("p"))
    bad = F.concat_ws(", ", *(F.when(F.col(f"p.`{c}`").isNull() | (F.trim(F.col(f"p.`{c}`").cast("string")) == ""), c) for c in NEEDED))
    wrong = F.raise_error(F.concat(F.lit("Properties without a valid "), bad, F.lit(": "), F.coalesce("__text", F.lit("null")))).cast("boolean")
    return one.filter(F.when(bad == "", True).otherwise(wrong)).select("p.*")


def read(spark: SparkSession, root: str, source: str, group: str, symbol: str) -> DataFrame:
    """One symbol's row."""
    return parsed(spark.read.text(properties_path(root, source, group, symbol), wholetext=True))


def with_point(bars: DataFrame, properties: DataFrame) -> DataFrame:
    """bars with point_size; a symbol without properties is an error. One row a symbol is joined, by size broadcast or not."""
    known = properties.select("symbol", "point_size")
    joined = bars.join(known, "symbol", "left")
    missing = F.raise_error(F.concat(F.lit("No properties of "), "symbol")).cast("boolean")
    return joined.filter(F.when(F.col("point_size").isNotNull(), True).otherwise(missing))
