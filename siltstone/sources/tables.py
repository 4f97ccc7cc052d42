"""Tables by name, dealt out to the cores that there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, or, where a scan of a few small files has fewer files than half the cores (each is mostly one
    row group, whatever the number of splits), dealt out evenly, so that work on long texts does not stay on
    one core. Large tables have more splits than cores and are never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores and len(df.inputFiles()) < max(2, cores // 2) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df
