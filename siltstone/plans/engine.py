"""The engine's public surface: questions in, DataFrames out.

Corpora are tables (views or paths) of the schemas in ``siltstone.schemas``; every model step is injected."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import tier as tier_of
from ..operators import audit, cache, contradiction, evaluation, relational, retrieval, tree
from . import nlsql, planner
from .models import Models

#: Per corpus: candidates of the dense search, results, and whether a date range applies before or after top k.
LIMITS = {"filings": (10, 6, None), "transcripts": (10, 10, "after"), "patents": (15, 8, "before"), "litigation": (10, 10, "after")}
BUDGETS = {"filings": 12_000, "transcripts": 10_000, "patents": 10_000, "litigation": 10_000}


class Engine:
    def __init__(self, spark: SparkSession, vectors: DataFrame | None = None, models: Models | None = None, tables: Mapping[str, DataFrame] | None = None):
        """vectors: namespace, id, embedding, text, date, and filter columns; tables: other tables by name."""
        self.spark, self.vectors, self.models, self.tables = spark, vectors, models or Models(), dict(tables or {})

    # -- retrieval ---------------------------------------------------------------------------

    def questions(self, rows: list[tuple[int, str]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "qid long, question string")

    def retrieve(self, question: str, corpus: str, spec: Mapping | None = None, start: str | None = None, end: str | None = None) -> DataFrame:  # R07
        """A corpus' answer to one question: filter, dense top k, date range, fusion with BM25, results.
        Patents' dates are part of the filter; the others' apply to what top k left."""
        k, results, dates = LIMITS[corpus]
        v = self.vectors.where(F.col("namespace") == corpus)
        if dates == "before":
            v = v.where(retrieval.date_filter(F.col("date"), start, end))
        asked = self.spark.range(1).select(F.lit(question).alias("question"))
        asked = asked.select(F.lit(0).alias("qid"), self.models.embed(F.col("question")).alias("query"), text.tokens("question").alias("terms"))
        near = retrieval.dense_many(v.where(retrieval.metadata_filter(spec)), asked.select("qid", "query"), k, "id")
        if dates == "after":
            near = near.join(v.select("id", "date"), "id").where(retrieval.date_filter(F.col("date"), start, end)).drop("date")
        candidates = near.join(v.select("id", "text"), "id")
        terms = asked.select("qid", F.explode("terms").alias("term"))
        fused = retrieval.hybrid(candidates, terms, "id", results)
        return fused.join(candidates.select("id", "score", "text"), "id").select("id", "final_rank", "rrf", "score", "text")

    def raptor_retrieve(self, question: str, edges: DataFrame, k: int = 10, results: int = 8) -> DataFrame:  # R06
        """Filings through the summary tree: hits on summaries become their leaves."""
        year, form = retrieval.question_filter(F.lit(question))
        named = self.spark.range(1).select(year.alias("year"), form.alias("form")).first()
        spec = {c: v for c, v in (("year", named["year"]), ("form_type", named["form"])) if v is not None and c in self.vectors.columns}
        v = self.vectors.where(F.col("namespace") == "filings")
        asked = self.spark.range(1).select(F.lit(0).alias("qid"), self.models.embed(F.lit(question)).alias("query"))
        near = retrieval.dense_many(v.where(retrieval.metadata_filter(spec)), asked, k, "id").join(v.select("id", "node_type"), "id")
        leaves = retrieval.merged_hits(retrieval.expand(near.select("id", "score", "node_type"), edges, v.select("id", "node_type")))
        ranked = relational.top_per(leaves.withColumn("qid", F.lit(0)), ["qid"], [F.desc("final_score"), F.col("id")], 1 << 30).join(v.select("id", "text"), "id")
        terms = self.spark.range(1).select(F.lit(0).alias("qid"), F.explode(text.tokens(F.lit(question))).alias("term"))
        fused = retrieval.hybrid(ranked.select("qid", "id", "rank", "text"), terms, "id", results)
        return fused.join(ranked.select("id", "text", "via", "final_score"), "id").select("id", "final_rank", "final_score", "via", "text")

    def context(self, results: DataFrame, corpus: str = "filings") -> DataFrame:  # W02
        return relational.budget(results, [], [F.col("final_rank")], "text", BUDGETS[corpus])

    # -- questions ---------------------------------------------------------------------------

    def plan(self, questions: DataFrame) -> DataFrame:  # Q01-Q04, M11
        """qid, pos, subquestion, route, plan, tier for a table of questions."""
        subs = planner.subquestions(questions)
        return subs.withColumn("tier", tier_of(F.col("plan"), F.col("route")))

    def graded(self, question: str, results: DataFrame) -> DataFrame:  # Q07
        return results.where(self.models.grade(F.lit(question), F.col("text")))

    def answer(self, question: str, corpus: str = "filings", **filters) -> DataFrame:  # LM07, LM11
        """answer and citations of one question over one corpus."""
        kept = self.context(self.graded(question, self.retrieve(question, corpus, **filters)), corpus)
        every = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "text", "id"))), lambda x: x["text"]).alias("contexts"), F.array_sort(F.collect_list("id")).alias("citations"))
        return every.select(F.lit(question).alias("question"), self.models.generate(F.lit(question), F.col("contexts")).alias("answer"), "citations", "contexts")

    def ask(self, question: str) -> tuple[str, DataFrame]:  # LM04
        if self.models.nl2sql is None:
            raise LookupError("no nl2sql function was given")
        return nlsql.ask(self.spark, question, self.models.nl2sql)

    def query(self, question: str, tenant: str = "default", corpus_version: int = 0) -> DataFrame:
        """One question through plan, retrieval and merge; an exact cache entry answers first."""
        scope = text.cache_scope(("tenant", F.lit(tenant)), ("version", F.lit(corpus_version)))
        key = text.query_hash(F.lit(question), scope)
        if "cache" in self.tables:
            probe = self.spark.range(1).select(key.alias("key"), F.lit(question).alias("question"))
            hit = cache.exact(self.tables["cache"], probe).where("hit").limit(1)
            if hit.count():
                return hit.select("question", "answer", F.lit(True).alias("cache_hit"), F.lit(None).cast("array<string>").alias("citations"))
        subs = self.plan(self.questions([(0, question)])).orderBy("pos").collect()  # a handful of parts
        answers = []
        for s in subs:
            corpus = s["route"] if s["route"] in LIMITS else "filings"
            answers.append(self.answer(s["subquestion"], corpus).withColumn("pos", F.lit(s["pos"])))
        merged = answers[0]
        for a in answers[1:]:
            merged = merged.unionByName(a)
        return merged.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "answer"))), lambda x: x["answer"]), "\n\n").alias("answer"), F.array_distinct(F.flatten(F.collect_list("citations"))).alias("citations")).select(
            F.lit(question).alias("question"), "answer", F.lit(False).alias("cache_hit"), "citations")

    # -- due diligence, evaluation, upkeep ------------------------------------------------------

    def due_diligence(self, figures: DataFrame, statements: DataFrame, on: list[str]) -> DataFrame:  # X01
        return contradiction.sweep(figures, statements, on).orderBy(F.desc("score"), *on)

    def cache_stats(self) -> DataFrame:
        return cache.stats(self.tables["cache"])

    def cache_clear(self) -> None:
        self.tables["cache"] = self.tables["cache"].limit(0)

    def eval_runs(self) -> DataFrame:
        return self.tables["eval_results"].groupBy("run_id").agg(F.max("completed_at").alias("completed_at"))

    def eval_latest(self) -> DataFrame:
        return evaluation.latest_run(self.eval_runs())

    def eval_summary(self, run_id: str) -> DataFrame:
        return evaluation.overall(self._means(run_id))

    def eval_ablation(self, run_id: str) -> DataFrame:
        return evaluation.deltas(self._means(run_id))

    def _means(self, run_id: str) -> DataFrame:
        return evaluation.tier_means(self.tables["eval_results"].where(F.col("run_id") == run_id))

    def audit_log(self, results: DataFrame) -> DataFrame:
        return audit.record(results)

    def verify_tree(self, nodes: DataFrame) -> DataFrame:
        return tree.issues(nodes)
