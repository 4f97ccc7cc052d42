"""Connected components of an edge table, without gathering edges, labels or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, settle


def components(edges: DataFrame, what: str = "labels") -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (a long, b long).

    Each round gives a node the smallest label around it and then its label's own label, so distances to
    the root about halve. Rounds are written to the shared folder: a lost executor costs one round."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both, f"{what}-edges")
    files = files_for(both.sparkSession, both.count())  # a count of Parquet footers
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), what, files)
    while True:  # labels only fall, so the rounds end
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        hooked = labels.join(around, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        onward = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = settle(hooked.join(onward, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), what, files)
        labels = moved.select("node", "root")
        if not moved.where("was <> root").limit(1).count():
            return labels
