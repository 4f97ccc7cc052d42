"""Evaluation metrics as aggregations and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

BASELINE = "naive_rag"
#: Configurations and what they switch on (nothing reads the switch kg).
CONFIGS = {"naive_rag": (), "plus_router": ("router",), "plus_reranker": ("router", "reranker"), "plus_kg": ("router", "reranker", "kg"), "full_system": ("router", "reranker", "kg")}


def mrr(ranked: DataFrame, query: str = "qid") -> DataFrame:  # E01
    """Reciprocal of the first relevant rank; 0 if none is. ranked: qid, rank, relevant."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return ranked.groupBy(query).agg(F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("mrr"))


def mrr_of_order(judged: DataFrame, order: list[Column], query: str = "qid") -> DataFrame:  # E01
    """As ``mrr``, from judged results (qid, relevant) and the order that ranks them: the first relevant one's place is
    the number of results before it, so nothing is sorted and a query with many results is no hot task."""
    first = judged.where("relevant").groupBy(query).agg(F.min(F.struct(*order)).alias("_first"))
    at = judged.select(query, F.struct(*order).alias("_key")).join(first, query, "left")
    before = F.count_if(F.col("_key") < F.col("_first"))
    return at.groupBy(query).agg(F.round(F.coalesce(F.when(F.max("_first").isNotNull(), 1.0 / (before + 1)), F.lit(0.0)), 6).alias("mrr"))


def ndcg(ranked: DataFrame, k: int = 5, query: str = "qid") -> DataFrame:  # E02
    """Binary NDCG at k; the ideal is the same relevance sorted. One result: its relevance."""
    rel = F.col("relevant").cast("int")
    top = ranked.where(F.col("rank") <= k).withColumn("rel", rel)
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rel"), "rank"))
    top = top.withColumn("ideal", ideal)
    gain = lambda at: F.sum(F.col("rel") / F.log2(F.col(at) + 1.0))
    both = top.groupBy(query).agg(gain("rank").alias("dcg"), gain("ideal").alias("idcg"), F.count("*").alias("n"), F.max("rel").alias("any"))
    value = F.when(F.col("any") == 0, 0.0).when(F.col("n") < 2, F.col("any").cast("double")).otherwise(F.col("dcg") / F.col("idcg"))
    return both.select(query, F.round(value, 6).alias("ndcg"))


def numerical_accuracy(answer: Column, expected: Column) -> Column:  # E03
    """Share of expected numbers found within one per cent; 1 if none is expected."""
    found = text.numbers(answer)
    hit = lambda e: F.exists(found, lambda x: F.when(e == 0, x == 0).otherwise(F.abs(x - e) / F.abs(e) <= 0.01))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) < 1, 1.0).otherwise(F.size(F.filter(expected, hit)) / F.size(expected))


def entity_presence(answer: Column, entities: Column) -> Column:  # E04
    low = F.lower(answer)
    return F.when(F.coalesce(F.size(entities), F.lit(0)) < 1, 1.0).otherwise(F.size(F.filter(entities, lambda e: F.contains(low, F.lower(e)))) / F.size(entities))


def citation_overlap(cited: Column, expected: Column) -> Column:  # E05
    low = lambda a: F.array_distinct(F.transform(a, lambda x: F.lower(x)))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) < 1, 1.0).otherwise(F.size(F.array_intersect(low(cited), low(expected))) / F.size(low(expected)))


def tier_means(scores: DataFrame) -> DataFrame:  # A10
    """Mean by config, tier and metric; items without the metric do not count."""
    return scores.groupBy("config", "tier", "metric").agg(F.round(F.avg("value"), 4).alias("mean"))


def overall(means: DataFrame) -> DataFrame:  # A11
    """Unweighted mean of tiers' means."""
    return means.groupBy("config", "metric").agg(F.round(F.avg("mean"), 4).alias("mean"))


def deltas(means: DataFrame, baseline: str = BASELINE) -> DataFrame:  # E08, J14
    """Difference from the baseline of the same tier and metric; a missing one counts as 0."""
    base = means.where(F.col("config") == baseline).select("tier", "metric", F.col("mean").alias("_base"))
    return means.where(F.col("config") != baseline).join(base, ["tier", "metric"], "left").select("config", "tier", "metric", F.round(F.col("mean") - F.coalesce("_base", F.lit(0.0)), 4).alias("delta"))


def latest_run(runs: DataFrame) -> DataFrame:  # W08
    return runs.agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))


def judged(items: DataFrame, judge, metrics: tuple[str, ...] = ("completeness", "contradiction_rate")) -> DataFrame:  # E06, E07
    """Scores of a judge function over items (id, answer, expected): one row per metric. judge(list of
    (answer, expected)) gives dicts; an unreadable answer scores 0, an item with nothing expected 1."""
    import pandas as pd

    kind = dict(items.dtypes)["id"]

    def run(frames):
        for f in frames:
            pairs = list(zip(f["answer"], f["expected"]))
            given = judge([p for p in pairs if p[1]])
            at, out = iter(given), []
            for i, (_, expected) in zip(f["id"], pairs):
                got = next(at) if expected else None
                for m in metrics:
                    try:
                        value = 1.0 if got is None else min(1.0, max(0.0, float(got[m])))
                    except (KeyError, TypeError, ValueError):
                        value = 0.0
                    out.append((i, m, value))
            yield pd.DataFrame(out, columns=["id", "metric", "value"])

    return items.select("id", "answer", "expected").mapInPandas(run, f"id {kind}, metric string, value double")


def skipped_failures(scores: DataFrame) -> DataFrame:  # A10
    """Scores of items that could be evaluated: a failed item has none and does not count."""
    return scores.where(F.col("value").isNotNull())
