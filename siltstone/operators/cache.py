"""The answer cache as a table: exact and similar look-ups, eviction by version and age, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import unit
from ..functions.text import any_in
from . import relational, vector_index
from .retrieval import laid_out, longest, product, question_blocks

TTL_SECONDS, SIMILAR = 3600, 0.92
UNCACHED_ROUTES = ("contradiction", "graph", "multi_hop")


def live(cache: DataFrame, now: Column, version: Column) -> DataFrame:
    """Entries that have not expired and are of the current version or a later one."""
    return cache.where((F.col("expires_at") > now) & (F.col("doc_version") >= version))


def exact(cache: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:  # C01
    """Each probe with the entry of its key, if there is one, and whether it hit."""
    found = cache.select(key, "answer")
    return probes.join(found, key, "left").withColumn("hit", F.col("answer").isNotNull())


def similar(cache: DataFrame, probes: DataFrame, threshold: float = SIMILAR, digits: int = 6) -> DataFrame:  # C02, C03
    """probe_id, entry_id, similarity: each probe's most similar entry of the same scope, from ``threshold`` on.
    cache: entry_id, source_filter, embedding; probes: probe_id, source_filter, embedding. A null scope is a scope of
    its own. Probes are broadcast a block at a time and entries stay where they are, so a scope that holds most
    entries is no hot key; the best is kept by an aggregation, so one candidate per probe and task travels."""
    scope = F.coalesce(F.col("source_filter").cast("string"), F.lit("")).alias("_scope")
    asked = probes.select("probe_id", scope, unit(F.col("embedding")).alias("_p"))
    d = longest(asked, "_p")
    entries = cache.select("entry_id", scope, unit(F.col("embedding")).alias("_e")).select("entry_id", "_scope", *laid_out(F.col("_e"), d, "_e"))
    found = []
    for block in question_blocks(asked, "probe_id"):
        block = block.select("probe_id", "_scope", *laid_out(F.col("_p"), d, "_p"))
        near = entries.join(F.broadcast(block), "_scope").where(product("_p", "_e", d) >= threshold - 10.0**-digits)
        scored = near.select("probe_id", "entry_id", F.round(product("_p", "_e", d), digits).alias("similarity"))
        best = scored.where((F.col("similarity") >= threshold) & (F.col("similarity") > 0)).groupBy("probe_id").agg(F.max(F.struct("similarity", (-F.col("entry_id")).alias("o"))).alias("b"))
        found.append(best.select("probe_id", (-F.col("b.o")).alias("entry_id"), F.col("b.similarity").alias("similarity")))
    if not found:
        return entries.crossJoin(asked.select("probe_id")).select("probe_id", "entry_id", F.lit(0.0).alias("similarity")).limit(0)
    return reduce(DataFrame.unionByName, found)


def similar_live(index: vector_index.VectorIndex, probes: DataFrame, now: object, version: int, threshold: float = SIMILAR) -> DataFrame:  # C02
    """``similar`` among entries that have not expired and are of the current version or a later one, through an index of
    them over entry_id that keeps source_filter, expires_at and doc_version: lists that hold nothing so similar are not
    read, and age and version stand before everything else."""
    asked = probes.select(F.col("probe_id").alias("qid"), F.col("embedding").alias("query"))
    found = vector_index.within(index, asked, threshold, {"expires_at": {"$gt": now}, "doc_version": {"$gte": version}}).withColumnRenamed("source_filter", "_scope")
    scoped = found.join(probes.select(F.col("probe_id").alias("qid"), "source_filter"), "qid").where(F.col("_scope").eqNullSafe(F.col("source_filter")) & (F.col("score") > 0))
    best = scoped.groupBy("qid").agg(F.max(F.struct("score", (-F.col("entry_id")).alias("o"))).alias("b"))
    return best.select(F.col("qid").alias("probe_id"), (-F.col("b.o")).alias("entry_id"), F.col("b.score").alias("similarity"))


def is_time_sensitive(question: Column) -> Column:  # C05
    return any_in(F.lower(question), fixed.RECENCY)


def storable(results: DataFrame) -> DataFrame:  # C06
    """Results that may be cached: not time-sensitive, and of a route whose answers keep."""
    return results.where(~F.col("route").isin(*UNCACHED_ROUTES) & ~is_time_sensitive(F.col("question")))


def promoted(hits: DataFrame, probes: DataFrame, cache: DataFrame) -> DataFrame:  # C06
    """Exact entries for probes that a similar entry answered."""
    return hits.join(probes.select("probe_id", "key", "question"), "probe_id").join(cache.select("entry_id", "answer", "source_filter", "doc_version", "expires_at"), "entry_id").select(F.lit("exact").alias("tier"), "key", "question", "answer", "source_filter", "doc_version", "expires_at")


def counted(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache with its hit counts raised."""
    n = hits.groupBy("key").agg(F.count("*").alias("_n"))
    return cache.join(n, "key", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def stats(cache: DataFrame) -> DataFrame:  # A13, C04
    return cache.groupBy("tier").agg(F.count("*").alias("entries"), F.sum("hit_count").alias("hits"))


def distinct_documents(docs: DataFrame, key: str, text: str) -> DataFrame:  # C04
    """The first document of each content hash."""
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    return relational.keep_first(hashed.select(key, "content_hash"), ["content_hash"], [key])
