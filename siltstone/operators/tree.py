"""Summary trees: building them level by level, and finding what is wrong with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import settled
from .mixture import cluster
from .relational import top_per

MAX_LEVELS, LEAST_NODES, TEXTS_PER_SUMMARY = 3, 4, 10


def summaries(clustered: DataFrame, level: int, summarize: Callable) -> DataFrame:
    """One summary per cluster: id (hash of its children), child_ids in order, text of its first ten children. Only
    those ten texts travel; of the others the id does, which the result lists."""
    key = ["source_doc_id", "cluster"]
    ids = clustered.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("child_ids"))
    first = top_per(clustered.select(*key, "id", "text"), key, [F.col("id")], TEXTS_PER_SUMMARY)
    texts = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("texts"))
    both = ids.withColumnRenamed("source_doc_id", "_s").join(texts, (F.col("_s").eqNullSafe(F.col("source_doc_id"))) & (ids["cluster"] == texts["cluster"]))
    return both.select(F.sha2(F.concat_ws("|", F.lit(str(level)), F.array_join("child_ids", ",")), 256).alias("id"), summarize(F.col("texts")).alias("text"), F.lit(level).alias("level"), F.lit("summary").alias("node_type"), "child_ids", "source_doc_id")


def build(leaves: DataFrame, embed: Callable[[DataFrame], DataFrame], summarize: Callable, levels: int = MAX_LEVELS, clusterer: Callable = cluster) -> DataFrame:  # T02
    """Nodes of the tree over leaves (id, text, source_doc_id): id, text, level, node_type, child_ids,
    parent_id, source_doc_id. All sources grow at once, each by its own clusters; one stops at three levels or where it
    has fewer than four nodes."""
    none = F.lit(None).cast("array<string>")
    every = leaves.select("id", "text", F.lit(0).alias("level"), F.lit("leaf").alias("node_type"), none.alias("child_ids"), "source_doc_id")
    current = every
    for level in range(1, levels + 1):
        enough = current.groupBy(F.col("source_doc_id").alias("_s")).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_NODES)
        current = current.join(enough, current["source_doc_id"].eqNullSafe(enough["_s"]), "left_semi")
        if current.isEmpty():
            break
        new = summaries(clusterer(embed(current.select("id", "text", "source_doc_id"))), level, summarize)
        new = settled(new.select("id", "text", "level", "node_type", "child_ids", "source_doc_id"), "tree-level")
        every, current = every.unionByName(new), new
    parents = every.where("child_ids is not null").select(F.col("id").alias("parent_id"), F.explode("child_ids").alias("id"))
    return every.join(parents, "id", "left")


def issues(nodes: DataFrame) -> DataFrame:  # T03, A12, G09
    """issue, id of everything wrong with a tree (id, text, level, node_type, child_ids, parent_id)."""
    links = nodes.select(F.col("id").alias("parent"), F.explode("child_ids").alias("child"))
    known = nodes.select(F.col("id").alias("child"))
    missing = links.join(known, "child", "left_anti").select(F.lit("missing_child").alias("issue"), F.col("child").alias("id"))
    wrong = nodes.where("parent_id is not null").join(links.withColumnsRenamed({"parent": "parent_id", "child": "id"}), ["parent_id", "id"], "left_anti").select(F.lit("bad_parent").alias("issue"), "id")
    empty = nodes.where("node_type = 'summary' and trim(coalesce(text, '')) = ''").select(F.lit("empty_summary").alias("issue"), "id")
    leaf = nodes.where("node_type = 'leaf' and size(coalesce(child_ids, array())) > 0").select(F.lit("leaf_with_children").alias("issue"), "id")
    from .graph import cycles

    rings = cycles(links.withColumnsRenamed({"parent": "src", "child": "dst"})).select(F.lit("cycle").alias("issue"), F.array_join("path", ">").alias("id"))
    return missing.union(wrong).union(empty).union(leaf).union(rings)


def is_ready(nodes: DataFrame) -> bool:
    counts = {r["node_type"]: r["count"] for r in nodes.groupBy("node_type").count().collect()}
    return bool(counts.get("leaf")) and bool(counts.get("summary")) and not issues(nodes).limit(1).count()


def self_test(spark: SparkSession, leaves: DataFrame, embed: Callable, summarize: Callable) -> DataFrame:  # T04
    """At most eight leaves, no summary level: what a build must pass unchanged."""
    return build(leaves.orderBy("id").limit(8), embed, summarize, levels=0)
