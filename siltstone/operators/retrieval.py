"""Dense search, BM25, rank fusion and the context that they fill.

Scans of vectors are exact. Many questions are answered at once: statistics and ranks are kept per
question, and the candidates of a question are few by construction (top k)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import blended, cosine, dot, unit
from ..functions.text import tokens
from ..sources.workspace import settled
from . import relational

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K = 60
MANY = 100_000  # terms and questions up to this number are broadcast
_OPS = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def metadata_filter(spec: Mapping | None) -> Column:  # P07
    """A filter such as ``{"$and": [{"year": {"$gte": 2021}}, {"form": "10-K"}]}`` as a predicate, which
    stands before top k (and is pushed down to the scan)."""
    out = F.lit(True)
    for key, value in (spec or {}).items():
        if key == "$and":
            out = reduce(lambda a, b: a & b, map(metadata_filter, value), out)
        elif key == "$or":
            out = out & reduce(lambda a, b: a | b, map(metadata_filter, value))
        elif isinstance(value, Mapping):
            for op, v in value.items():
                out = out & (F.col(key).isin(*v) if op == "$in" else getattr(F.col(key), _OPS[op])(F.lit(v)))
        else:
            out = out & (F.col(key) == F.lit(value))
    return out


def question_filter(question: Column) -> tuple[Column, Column]:  # P08
    """Year and form that a question names: its first year from 2000 to 2099; 10-K before 10-Q."""
    year = F.regexp_extract(question, r"\b(20\d{2})\b", 1).try_cast("int")
    form = F.when(F.upper(question).contains("10-K"), "10-K").when(F.upper(question).contains("10-Q"), "10-Q")
    return year, form


def date_filter(date: Column, start: str | None = None, end: str | None = None) -> Column:  # P09
    """After top k: a missing date fails a lower bound and passes an upper one."""
    d, out = F.coalesce(date.cast("string"), F.lit("")), F.lit(True)
    if start:
        out = out & (d >= start)
    return out & (d <= end) if end else out


def dense(vectors: DataFrame, query: Column, k: int, key: str, spec: Mapping | None = None, digits: int = 6) -> DataFrame:  # R01
    """The k vectors nearest to one query, with score and rank: filter, score, keep k per task, merge."""
    scored = vectors.where(metadata_filter(spec)).withColumn("score", F.round(cosine(F.col("embedding"), query), digits))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


#: Questions whose vectors are broadcast at a time: 1024 vectors of 1536 doubles are 12 MB.
QUESTION_BLOCK = 1024


def question_blocks(queries: DataFrame, key: str, size: int = QUESTION_BLOCK) -> list[DataFrame]:
    """``queries`` in blocks of ``size`` rows, numbered once in the shared folder; each may be broadcast."""
    places = relational.ranked(queries.select(key).distinct(), [F.col(key)], "_n").withColumn("_n", F.col("_n") - 1)
    numbered = settled(queries.join(places, key), "questions")
    n = numbered.agg(F.coalesce(F.max("_n") + 1, F.lit(0))).first()[0]
    return [numbered.where((F.col("_n") >= a) & (F.col("_n") < a + size)).drop("_n") for a in range(0, n, size)]


#: Vectors up to this length are laid out as columns, so that a product of two is compiled code and no walk over arrays.
UNROLLED = 128
#: One vector in so many gives a first floor for what a question's best k score.
SAMPLED = 64


def laid_out(v: Column, d: int, name: str) -> list[Column]:
    """The d components of a vector as columns, with its length (null if a component is)."""
    if d > UNROLLED:
        return [v.alias(name)]
    length = F.when(F.forall(v, lambda x: x.isNotNull()), F.size(v)).alias(f"{name}_n")
    return [length, *(F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)).alias(f"{name}_{i}") for i in range(d))]


def product(a: str, b: str, d: int) -> Column:
    """``dot`` of two vectors that are laid out, with the same order of addition; null if their lengths differ."""
    if d > UNROLLED:
        return dot(F.col(a), F.col(b))
    total = reduce(lambda s, i: s + F.col(f"{a}_{i}") * F.col(f"{b}_{i}"), range(d), F.lit(0.0))
    return F.when(F.col(f"{a}_n") == F.col(f"{b}_n"), total)


def longest(vectors: DataFrame, vector: str) -> int:
    return vectors.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def dense_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, digits: int = 6) -> DataFrame:  # J12
    """Exact top k for each query (qid, query): a block of queries at a time is broadcast to a scan of all vectors, so
    vectors never travel. The k-th best of one vector in SAMPLED is a floor below which no vector can be among the best;
    only pairs that reach it are sorted, and a group limit keeps k of them per query and task."""
    asked = queries.select("qid", unit(F.col("query")).alias("query"))
    d, order = longest(asked, "query"), [F.desc("score"), F.col(key)]
    each = vectors.select(key, unit(F.col("embedding")).alias("_unit")).select(key, *laid_out(F.col("_unit"), d, "_v"))
    score = product("_v", "_q", d)
    scored = ["qid", key, F.round(score, digits).alias("score")]
    best = []
    for block in question_blocks(asked, "qid"):
        block = block.select("qid", *laid_out(F.col("query"), d, "_q"))
        some = each.where(F.pmod(F.xxhash64(key), F.lit(SAMPLED)) == 0).crossJoin(F.broadcast(block)).select(*scored)
        floors = relational.top_per(some, ["qid"], order, k).groupBy("qid").agg(F.when(F.count("score") >= k, F.min("score")).alias("_floor"))
        met = each.crossJoin(F.broadcast(block.join(floors, "qid", "left")))
        near = met.where(F.col("_floor").isNull() | (score >= F.col("_floor") - 10.0**-digits)).select(*scored)
        best.append(relational.top_per(near, ["qid"], order, k))
    if not best:
        none = vectors.crossJoin(asked).select("qid", key, F.lit(0.0).alias("score")).limit(0)
        best = [relational.top_per(none, ["qid"], order, k)]
    return reduce(DataFrame.unionByName, best)


def bm25(docs: DataFrame, terms: DataFrame, key: str, text: str = "text", digits: int = 6) -> DataFrame:  # R02, A16
    """qid, key, bm25 of every candidate document. docs: qid, key, text (a question's candidates); terms:
    qid, term (a term asked twice counts twice). Okapi weights; a negative idf becomes a quarter of the
    mean idf over the candidates' terms."""
    # Only term counts per question travel (summed up before the shuffle); a document's own counts of the
    # few asked terms are taken from its words in place. Sides that grow with the questions are broadcast if they are few.
    few = terms.limit(MANY + 1).count() <= MANY and docs.select("qid").distinct().limit(MANY + 1).count() <= MANY
    small = F.broadcast if few else lambda side: side
    bags = docs.select("qid", key, tokens(text).alias("_t")).withColumn("dl", F.size("_t"))
    size = bags.groupBy("qid").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = bags.select("qid", F.explode(F.array_distinct("_t")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("df"))
    idf = df.join(small(size), "qid").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # a row per question
    asked = terms.groupBy("qid", "term").agg(F.count("*").alias("times"))
    of_asked = idf.join(small(asked), ["qid", "term"])
    mean = idf.groupBy("qid").agg(F.avg("idf").alias("mean"))
    of_asked = of_asked.join(small(mean), "qid").select("qid", "term", "times", "avgdl", F.when(F.col("idf") < 0, FLOOR * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    hits = bags.join(small(of_asked), "qid").where(F.array_contains("_t", F.col("term"))).withColumn("tf", F.size(F.filter("_t", lambda x: x == F.col("term"))))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = hits.groupBy("qid", key).agg(F.round(F.sum(weight), digits).alias("bm25"))
    return docs.select("qid", key).join(score, ["qid", key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def rrf(ranked: DataFrame, key: str, digits: int = 6) -> DataFrame:  # R03, A15
    """qid, key, rrf from ranked lists (qid, key, rank); empty keys are skipped, repeated ones add up."""
    kept = ranked.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.groupBy("qid", key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), digits).alias("rrf"))


def hybrid(candidates: DataFrame, terms: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:  # R04
    """Fuses the dense rank of a question's candidates (qid, key, rank, text) with their BM25 rank; ties go
    to the better dense rank."""
    lexical = bm25(candidates, terms, key, text).join(candidates.select("qid", key, F.col("rank").alias("dense_rank")), ["qid", key])
    by_text = Window.partitionBy("qid").orderBy(F.desc("bm25"), "dense_rank")
    lists = lexical.withColumn("lexical_rank", F.row_number().over(by_text).cast("long"))
    both = lists.select("qid", key, F.col("dense_rank").alias("rank")).union(lists.select("qid", key, F.col("lexical_rank").alias("rank")))
    fused = rrf(both, key).join(lists, ["qid", key])
    return relational.top_per(fused, ["qid"], [F.desc("rrf"), F.col("dense_rank")], k, "final_rank")


def expand(hits: DataFrame, edges: DataFrame, nodes: DataFrame, cap: int | None = None) -> DataFrame:  # R05, J11
    """Leaves under the summaries among ``hits`` (id, score, node_type), with the summary's score and the
    immediate parent; direct leaves come as they are. edges: parent_id, child_id, pos; nodes: id, node_type.
    A path never returns to a node it has passed, and goes on until it meets no summary, however deep the tree."""
    out = hits.where("node_type = 'leaf'").select("id", "score", F.lit(None).cast("string").alias("via"))
    front = hits.where("node_type = 'summary'").select("id", "score", F.array("id").alias("path"))
    links = edges if cap is None else relational.top_per(edges, ["parent_id"], [F.col("pos"), F.col("child_id")], cap, "_n").drop("_n")
    while not front.isEmpty():
        step = front.join(links, front["id"] == links["parent_id"]).select(F.col("child_id"), "score", F.col("parent_id").alias("via"), "path")
        step = step.where(~F.array_contains("path", F.col("child_id"))).join(nodes.select(F.col("id").alias("child_id"), "node_type"), "child_id")
        step = settled(step, "expanded")
        out = out.unionByName(step.where("node_type = 'leaf'").select(F.col("child_id").alias("id"), "score", "via"))
        front = step.where("node_type = 'summary'").select(F.col("child_id").alias("id"), "score", F.concat("path", F.array("child_id")).alias("path"))
    return out


def merged_hits(leaves: DataFrame) -> DataFrame:  # R06: M07, A02, O02
    """One row per leaf: a direct hit wins over an expanded one, then the better score; expanded scores are damped."""
    scored = leaves.withColumn("final_score", blended(F.col("score"), F.col("via")))
    return relational.keep_first(scored, ["id"], [F.col("via").isNotNull(), -F.col("final_score"), F.coalesce("via", F.lit(""))])


def context(ranked: DataFrame, key: str, order: Column, text: str, limit: int, group: list[str] | None = None) -> DataFrame:  # W02, F39
    """The blocks of a context in order, within the limit of characters."""
    return relational.budget(ranked, group or [], [order, F.col(key)], text, limit)


def evidence(**routes: DataFrame) -> DataFrame:  # R08
    """Routes' results (content, score) as one table; a route without results adds no rows."""
    frames = [df.select(F.lit(name).alias("route"), F.col("content").cast("string").alias("content"), F.col("score").cast("double").alias("score")) for name, df in routes.items()]
    return reduce(DataFrame.unionByName, frames)
