"""Session settings every query relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC so that epoch buckets agree with other engines; AQE for skew and partition sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build(master: str | None = None, app: str = "barloom", **more: str) -> SparkSession:
    """A session with SETTINGS; `more` has further settings with "__" for "."."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
