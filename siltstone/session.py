"""The session's settings that results depend on, and defaults for size."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "siltstone", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` (dots as double underscores) wins over them."""
    b = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (b.master(master) if master else b).getOrCreate()
