"""Planning and routing of questions as Column expressions, so that a table of questions is planned in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_in, clean_question, lowered_tokens
from ..operators.graph import on_topic
from ..operators.relational import keep_first

SAME, APART = 0.6, 0.55
MAX_ATTEMPTS = 3


def is_comparison(question: Column) -> Column:
    return question.rlike("(?i)" + "|".join(f"(?:{p})" for p in fixed.COMPARISONS))


def route_hint(question: Column, markers: dict[str, tuple[str, ...]] = fixed.MARKERS) -> Column:  # Q01
    """The first route, in order, one of whose markers is a substring; comparisons of statements with
    filings come first."""
    low = F.lower(question)
    has = lambda r: any_in(low, markers[r]) if markers.get(r) else F.lit(False)
    out = F.when(is_comparison(question) & (has("transcripts") | has("filings")), "contradiction")
    for r in ("graph", "sql", "filings", "transcripts", "patents", "litigation"):
        out = out.when(has(r), r)
    return out.otherwise("llm_direct")


def topics(question: Column) -> Column:  # Q02
    low = F.lower(question)
    return F.array_compact(F.array(*(F.when(any_in(low, phrases), name) for name, (phrases, _, _) in fixed.TOPICS.items())))


def parts(question: Column) -> Column:
    """What stands between question marks, cleaned."""
    return F.filter(F.transform(F.split(question, r"\?+"), lambda x: clean_question(x)), lambda p: p != "")


def meaning(text: Column) -> Column:
    return F.array_except(F.array_distinct(lowered_tokens(text)), F.array(*map(F.lit, fixed.STOPWORDS)))


def overlap(a: Column, b: Column) -> Column:  # U02
    x, y = meaning(a), meaning(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def decomposes(question: Column) -> Column:  # Q03
    p, q = parts(question), clean_question(question)
    low = F.lower(q)
    mixed = F.size(F.array_distinct(F.transform(p, lambda x: route_hint(x)))) > 1
    apart = F.exists(F.slice(p, 2, 1 << 20), lambda x: overlap(F.get(p, F.lit(0)), x) < APART)
    both = any_in(low, fixed.MARKERS["transcripts"]) & any_in(low, fixed.MARKERS["filings"])
    return ((F.size(p) > 1) & (mixed | apart)) | (is_comparison(q) & ((F.size(topics(q)) >= 2) | both))


def subquestions(df: DataFrame, key: str = "qid", question: str = "question") -> DataFrame:  # Q03, Q04
    """qid, pos, subquestion, route, plan: the parts of a question that decomposes, or else the topics'
    summary questions; repeated ones once; fewer than two leave the question whole."""
    q = F.col(question)
    p = parts(q)
    table = F.array(*(F.struct(F.lit(n).alias("t"), F.lit(s).alias("q"), F.lit(r).alias("r")) for n, (_, s, r) in fixed.TOPICS.items()))
    low = F.lower(clean_question(q))
    asked = any_in(low, fixed.MARKERS["transcripts"]) & any_in(low, fixed.MARKERS["filings"] + fixed.MARKERS["sql"]) & is_comparison(q)
    of_topics = F.concat(
        F.transform(F.filter(table, lambda x: F.array_contains(topics(clean_question(q)), x["t"])), lambda x: F.struct(clean_question(x["q"]).alias("q"), x["r"].alias("r"))),
        F.when(asked, F.array(F.struct(clean_question(F.lit(fixed.CONTRADICTION_QUESTION)).alias("q"), F.lit("contradiction").alias("r")))).otherwise(F.array().cast("array<struct<q:string,r:string>>")),
    )
    of_parts = F.transform(p, lambda x: F.struct(x.alias("q"), route_hint(x).alias("r")))
    cut = df.select(key, q.alias("_whole"), decomposes(q).alias("_multi"), F.posexplode(F.when(F.size(p) > 1, of_parts).otherwise(of_topics)).alias("pos", "s")).where("_multi")
    once = keep_first(cut.withColumn("_low", F.lower("s.q")), [key, "_low"], ["pos"])
    several = once.groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 2").select(key)
    multi = once.join(several, key, "left_semi").select(key, F.col("pos").cast("long").alias("pos"), F.col("s.q").alias("subquestion"), F.col("s.r").alias("route"), F.lit("multi").alias("plan"))
    single = df.join(several, key, "left_anti").select(key, F.lit(0).cast("long").alias("pos"), q.alias("subquestion"), route_hint(q).alias("route"), F.lit("single").alias("plan"))
    return multi.unionByName(single)


def too_similar(subs: DataFrame, key: str = "qid") -> DataFrame:  # J13
    """Pairs of a question's sub-questions (a handful each) that say the same."""
    a, b = subs.select(key, F.col("pos").alias("i"), F.col("subquestion").alias("a")), subs.select(key, F.col("pos").alias("j"), F.col("subquestion").alias("b"))
    return a.join(b, key).where("i < j").where(overlap(F.col("a"), F.col("b")) >= SAME)


def planned(df: DataFrame, model: DataFrame, key: str = "qid", question: str = "question") -> DataFrame:  # Q04, LM06
    """As ``subquestions``, but from a model's plans (qid, pos, subquestion, route or null) where they hold: the question
    decomposes, two parts or more are left when repeated ones went, and no two of them say the same."""
    told = model.select(key, "pos", clean_question(F.col("subquestion")).alias("subquestion"), "route").where("subquestion <> ''")
    told = keep_first(told.withColumn("_low", F.lower("subquestion")), [key, "_low"], ["pos"]).drop("_low")
    whole = df.where(decomposes(F.col(question))).select(key)
    several = told.groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 2").select(key)
    good = several.join(whole, key, "left_semi").join(too_similar(told, key).select(key).distinct(), key, "left_anti")
    ours = told.join(good, key, "left_semi").select(key, F.col("pos").cast("long").alias("pos"), "subquestion", F.coalesce("route", route_hint(F.col("subquestion"))).alias("route"), F.lit("multi").alias("plan"))
    return ours.unionByName(subquestions(df.join(good, key, "left_anti"), key, question))


def route(question: Column, forced: Column, evaluating: Column, model: Column) -> Column:  # Q05
    return F.when(evaluating, "filings").when(on_topic(question), "graph").when(forced.isNotNull(), forced).otherwise(F.coalesce(model, route_hint(question)))


def web_question(question: Column, route_: Column) -> Column:  # Q06
    low, out = F.lower(question), None
    for routes, words, suffix in fixed.WEB_SUFFIXES:
        hit = route_.isin(*routes) | any_in(low, words)
        text = F.concat(question, F.lit(f" {suffix}"))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(F.concat(question, F.lit(f" {fixed.WEB_DEFAULT}")))


def after_grading(kept: Column, route_: Column, tried_graph: Column, attempts: Column, limit: int = MAX_ATTEMPTS) -> Column:  # Q09
    return F.when(kept > 0, "generate").when(route_ == "graph", "end").when((route_ == "filings") & ~tried_graph, "graph_fallback").when(attempts < limit, "rewrite").otherwise("web_search")


def after_answer(grounded: Column, useful: Column, tries: Column, limit: int = MAX_ATTEMPTS) -> Column:  # Q10
    return F.when((grounded == "yes") & (useful == "yes"), "end").when(tries >= limit, "end").when(grounded != "yes", "generate").otherwise("web_search")


def merged(results: DataFrame, key: str = "qid") -> DataFrame:  # Q11, A14
    """qid, kind, value, pos: citations and contexts of a question's sub-results, each once, in order of first use."""
    each = [results.select(key, "pos", F.lit(kind).alias("kind"), F.posexplode(column).alias("n", "value")) for kind, column in (("citation", "citations"), ("context", "contexts"))]
    every = reduce(DataFrame.unionByName, each)
    return keep_first(every, [key, "kind", "value"], ["pos", "n"]).select(key, "kind", "value", "pos", "n")
