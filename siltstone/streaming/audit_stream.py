"""Streaming audit ingestion: an extension beyond the batch engine.

Event time drives everything: a watermark bounds the state, windows close when it passes, and repeated
query ids are dropped within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; zone-less times count as UTC."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and their mean value by window and type, each event id counted once."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return once.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "avg_value")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows; what is there is taken in one go, then the query ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
