"""Bars of a stream of ticks: watermarked tumbling windows, closed when they can't change any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """symbol, time and prices per bucket of ticks (symbol, ts timestamp, value, tick_id)."""
    order = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("*").cast("double").alias("tick_volume"),
            F.sum("value").alias("real_volume"),
        )
        .select("symbol", F.unix_timestamp("w.start").alias("time"), "open", "high", "low", "close", "tick_volume", "real_volume", (F.col("high") - F.col("low")).alias("spread"))
    )
