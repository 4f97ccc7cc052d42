"""Indexes against full scans: vectors in inverted lists, postings in blocks."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import postings, relational, retrieval, substrings, vector_index

VECTORS = "id long, embedding array<double>, part int"


def clustered(n, dims=12, centres=15, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims)) * 5
    return [(i, (c[i % centres] + r.normal(size=dims) * 0.3).tolist(), i % 3) for i in range(n)]


def exact(rows, queries, k, where=lambda part: True):
    out = set()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v in queries:
        s = sorted((-round(float(unit(v) @ unit(x)), 6) + 0.0, i) for i, x, p in rows if where(p))
        out |= {(q, i, -d + 0.0, n + 1) for n, (d, i) in enumerate(s[:k])}
    return out


def told(df):
    return {(r.qid, r.id, r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("lists", [1, 15, 60])
def test_search_equals_a_scan(spark, lists):
    rows = clustered(400)
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)] + [(2000, [0.0] * 12, 0), (2001, [0.0] * 12, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    queries = [(i, rows[i][1]) for i in range(0, 400, 37)] + [(900, [0.0] * 12), (901, [-x for x in rows[3][1]])]
    asked = spark.createDataFrame(queries, "qid long, query array<double>")
    index = vector_index.build(df, "id", keep=("part",), lists=lists, deepest=10)
    assert told(vector_index.search(index, asked, 10)) == exact(rows, queries, 10)
    assert told(vector_index.search(index, asked, 4, {"part": {"$gte": 1}})) == exact(rows, queries, 4, lambda p: p >= 1)
    near = {(r.qid, r.id) for r in vector_index.within(index, asked, 0.9).collect()}
    assert near <= {(q, i) for q, i, s, _ in exact(rows, queries, 500) if s >= 0.9} and len(near) > 300
    with pytest.raises(ValueError, match="equal vectors"):
        vector_index.search(index, asked, 11)


def test_most_vectors_are_not_looked_at(spark):
    rows = clustered(600)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 600, 50)], "qid long, query array<double>")
    read, every = vector_index.looked_at(vector_index.build(spark.createDataFrame(rows, VECTORS), "id", lists=30), asked, 5)
    assert every == 12 * 600 and read < 0.2 * every


def test_lists_that_no_question_needs_are_not_opened(spark):
    rows = clustered(600)
    index = vector_index.build(spark.createDataFrame(rows, VECTORS), "id", lists=30)
    asked = vector_index._asked(spark.createDataFrame([(1, rows[1][1])], "qid long, query array<double>"))
    probes = vector_index._first_lists(vector_index._reach(index, asked), 5)
    plan = vector_index._scored(index, asked, probes, None, 6, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "list#" in plan.split("PartitionFilters:")[1]


def test_vector_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [nan, 1.0], 0), (5, [1.0], 0), (6, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("list", F.lit("x")).withColumn("gap", F.lit(1))
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "qid long, query array<double>")
    assert told(vector_index.search(vector_index.build(df, "id"), asked, 5)) == {(1, 1, 1.0, 1), (1, 6, 0.0, 2)}
    empty = vector_index.build(df.limit(0), "id")
    assert vector_index.search(empty, asked, 5).collect() == []
    assert vector_index.search(vector_index.build(df, "id"), asked.limit(0), 5).collect() == []


def test_postings_equal_a_scan(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(400)] + [(400, None), (401, "")] + [(500 + i, "w1 w2 w2") for i in range(40)]
    d = spark.createDataFrame(docs, "doc long, text string").withColumn("block", F.lit(0)).withColumn("top", F.lit("t"))
    questions = [(q, w) for q in range(12) for w in [r.choice(words) for _ in range(r.randint(1, 6))] + ["unheard"]] + [(99, "w2"), (99, "w2"), (99, None)]
    terms = spark.createDataFrame(questions, "qid long, term string")
    index = postings.build(d, "doc")
    got = {(x.qid, x.doc, x.bm25) for x in postings.search(index, terms, 10).collect()}
    known = terms.where("term is not null")
    scan = retrieval.bm25(known.select("qid").distinct().crossJoin(d.select("doc", F.coalesce("text", F.lit("")).alias("text"))), known, "doc").where("bm25 <> 0")
    want = {(x.qid, x.doc, x.bm25) for x in relational.top_per(scan, ["qid"], [F.desc("bm25"), F.col("doc")], 10).collect()}
    assert got == want and len(want) > 80
    monkeypatch.setattr(postings, "QUESTIONS", 5)
    assert {(x.qid, x.doc, x.bm25) for x in postings.search(index, terms, 10).collect()} == want
    read, every = postings.share_read(index, terms.where("qid < 12"), 3)
    assert 0 < read < every
    assert postings.search(postings.build(d.limit(0), "doc"), terms, 5).collect() == []


def test_common_words_of_a_small_corpus(spark):
    """Where every word is common the mean weight is negative, and so are scores."""
    d = spark.createDataFrame([(i, "a b c" if i % 4 else "a b") for i in range(40)], "doc long, text string")
    terms = spark.createDataFrame([(1, "a"), (1, "c")], "qid long, term string")
    got = {(x.doc, x.bm25) for x in postings.search(postings.build(d, "doc"), terms, 10).collect()}
    scan = retrieval.bm25(d.withColumn("qid", F.lit(1)), terms, "doc")
    want = {(x.doc, x.bm25) for x in relational.top_per(scan, ["qid"], [F.desc("bm25"), F.col("doc")], 10).collect()}
    assert got == want


def test_common_words_cost_no_row_for_each_question_and_document(spark):
    """A word that every document holds is looked up only for documents that hold a rarer word of the question."""
    r = random.Random(6)
    rows = [(i, " ".join(["the"] * r.randint(1, 5) + ["of"] * r.randint(1, 5) + [f"w{r.randint(0, 60)}" for _ in range(8)] + [f"x{i}"] * r.randint(0, 9))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    terms = spark.createDataFrame([(q, w) for q in range(8) for w in ("the", "of", f"w{q}", f"w{q + 9}")], "qid long, term string")
    index = postings.build(docs, "doc")
    got = {(x.qid, x.doc, x.bm25) for x in postings.search(index, terms, 3).collect()}
    scan = retrieval.bm25(terms.select("qid").distinct().crossJoin(docs), terms, "doc")
    assert got == {(x.qid, x.doc, x.bm25) for x in relational.top_per(scan, ["qid"], [F.desc("bm25"), F.col("doc")], 3).collect()}
    read, every = postings.share_read(index, terms, 3)
    assert every > 8 * 2 * 1200 and read < every / 6


def test_postings_of_odd_texts(spark):
    """Only letters and digits of ASCII are words, whatever lower-casing makes of other signs; signs at the ends are none."""
    docs = spark.createDataFrame([(1, "\u212a K k-K\u0130I"), (2, " a1 A1, b"), (3, ""), (4, None), (5, "\u00e9"), (6, "b")], "doc long, text string")
    got = sorted((x._key, x.dl, x.term, x.tf) for x in postings.build(docs, "doc").rows.collect())
    assert got == [(1, 4, "i", 1), (1, 4, "k", 3), (2, 3, "a1", 2), (2, 3, "b", 1), (6, 1, "b", 1)]


def test_postings_are_no_rows(spark, monkeypatch):
    """What is written on the way has a row for a block, a word or a hit, never one for each posting of the index."""
    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 150)}" for _ in range(100))) for i in range(2000)], "doc long, text string").repartition(3)
    terms = spark.createDataFrame([(q, f"w{r.randint(0, 160)}") for q in range(6) for _ in range(5)], "qid long, term string")
    rows = {}

    def noted(df, what, settled=postings.settled):
        out = settled(df, what)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(postings, "settled", noted)
    index = postings.build(docs, "doc")
    got = {(x.qid, x.doc, x.bm25) for x in postings.search(index, terms, 10).collect()}
    scan = retrieval.bm25(terms.select("qid").distinct().crossJoin(docs), terms, "doc")
    assert got == {(x.qid, x.doc, x.bm25) for x in relational.top_per(scan, ["qid"], [F.desc("bm25"), F.col("doc")], 10).collect()}
    assert index.rows.count() > 80_000 and max(rows.values()) < 2000


def test_blocks_of_postings(monkeypatch):
    """Blocks hold every document once, whatever their bounds and however a text is sliced."""
    r = random.Random(10)
    texts = [" ".join("".join(r.choice("aB1") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, "", "a" * 90, "\u00e9a" * 30, ", ".join("xyz" * 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["_key", "_t"])
    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    want = sorted((i, len(w), t, n) for i, w in enumerate(words) for t, n in Counter(w).items())
    for docs, size, piece in ((4096, 8 << 20, 1 << 20), (7, 8 << 20, 20), (4096, 300, 1), (1, 1, 64)):
        monkeypatch.setattr(postings, "DOCS", docs)
        monkeypatch.setattr(postings, "TEXT", size)
        monkeypatch.setattr(postings, "SLICE", piece)
        blocks = list(postings._blocks(iter([batch])))
        assert [k for b in blocks for k in b.column(0)[0].as_py()] == list(range(len(texts)))
        assert max(len(b.column(0)[0]) for b in blocks) <= docs and sum(b.column(6)[0].as_py() for b in blocks) == sum(map(len, words))
        assert sorted(tuple(x.values()) for b in postings._rows(iter(blocks)) for x in b.to_pylist()) == want


def test_containing_equals_all_pairs(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcé ß😀") for _ in range(n))
    texts = [word(r.randint(0, 30)) for _ in range(200)] + [None, "", "abc", "abcabc"]
    patterns = [word(r.randint(1, 6)) for _ in range(80)] + [None, "", "abc", "abc", "nowhere", "a", "😀", "bc"]
    df = lambda v, c: spark.createDataFrame([(x, 1) for x in v], f"{c} string, gram int")
    found = substrings.containing(df(patterns, "p"), df(texts, "t"), "p", "t")
    got = [(x.pattern, x.text) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, t) for p in patterns for t in texts if p and t and p in t}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert substrings.containing(df([], "p"), df(texts, "t"), "p", "t").collect() == [] == substrings.containing(df(patterns, "p"), df([], "t"), "p", "t").collect()
