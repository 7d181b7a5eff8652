"""Reading bar tables, and hourly bars made from the events table.

Times are epoch seconds, so no result depends on a session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.resample import SECONDS

#: A window's features in this order, after time.
FEATURES = ("open", "close", "high", "low", "real_volume", "spread", "tick_volume")
REQUIRED = ("time", *FEATURES)
COLUMNS = ("symbol", "time", "open", "high", "low", "close", "tick_volume", "real_volume", "spread")


def check_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    return df


def raw_path(root: str, source: str, group: str, symbol: str) -> str:
    for name, value in (("source", source), ("group", group), ("symbol", symbol)):
        if not value or not value.strip():
            raise ValueError(f"{name} is empty")
    return f"{root.rstrip('/')}/{source.strip()}/{group.strip()}/{symbol.strip()}/{symbol.strip()}_M1.parquet"


def read_symbol(spark: SparkSession, root: str, source: str, group: str, symbol: str) -> DataFrame:
    """One symbol's minute bars; only the known columns are read from the file."""
    df = check_columns(spark.read.parquet(raw_path(root, source, group, symbol)))
    return with_epoch(df).withColumn("symbol", F.lit(symbol.strip()))


def with_epoch(df: DataFrame) -> DataFrame:
    """`time` as epoch seconds; a time that can't be read is an error."""
    kind = dict(df.dtypes)["time"]
    if kind in ("bigint", "int"):
        return df
    if kind == "timestamp_ntz":
        return df.withColumn("time", epoch("time"))
    return df.withColumn("time", F.unix_timestamp(F.col("time").cast("timestamp")))


def epoch(column: str) -> F.Column:
    """Epoch seconds of a timestamp without time zone, from its fields: no session zone has a part in it."""
    days = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def from_events(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Bars of `value` by event_type; first and last by (ts, event_id). Partial sums run before the shuffle."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    width, order = SECONDS[timeframe], F.struct("ts", "event_id")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), (F.floor(epoch("ts") / width) * width).cast("long").alias("time"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("*").cast("double").alias("tick_volume"),
            F.sum("value").alias("real_volume"),
            (F.max("value") - F.min("value")).alias("spread"),
        )
        .select(*COLUMNS)
    )
