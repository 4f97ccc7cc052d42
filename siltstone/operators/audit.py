"""The audit log and the reports that compliance asks of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import confidence
from ..functions.text import context_key


def record(results: DataFrame) -> DataFrame:  # L01, M09
    """Audit rows from query results: sources from the contexts' identity, graph paths as ``a -> b -> c``."""
    paths = F.transform("graph_paths", lambda p: F.array_join(p, " -> "))
    return results.select(
        "query_id", "timestamp", "tenant_id", "user_id", "question", "route", F.transform("contexts", lambda x: context_key(x)).alias("sources_retrieved"), paths.alias("graph_paths_traversed"),
        confidence(F.col("cache_hit"), F.col("grounded"), F.col("useful")).alias("confidence"), "cache_hit", "latency_ms")


def append(df: DataFrame, path: str) -> None:  # K14
    """Partitioned by day, so that reports on a span of days read those days only."""
    df.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def recent(log: DataFrame, since: Column) -> DataFrame:  # L02
    return log.where(F.col("timestamp") >= since).groupBy("tenant_id").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def by_route(log: DataFrame) -> DataFrame:  # L02, A08
    return log.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def hit_rate(log: DataFrame) -> DataFrame:  # L02, A08
    return log.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("hits"), F.round(100.0 * F.count_if("cache_hit") / F.count("*"), 4).alias("hit_rate"))


def doubtful(log: DataFrame, below: float = 0.6) -> DataFrame:  # L02
    return log.where((F.col("route") == "contradiction") & (F.col("confidence") < below))
