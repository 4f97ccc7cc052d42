"""Operators on small fixtures, and properties that hold for any data."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.numeric import dot, unit
from siltstone.operators import cache, chunking, contradiction, evaluation, graph, relational, retrieval, tree
from siltstone.plans import planner


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bm25_and_hybrid(spark):
    docs = spark.createDataFrame([(0, "a", 1, "revenue growth"), (0, "b", 2, "patent litigation risk"), (0, "c", 3, "board of directors")], "qid int, id string, rank long, text string")
    terms = spark.createDataFrame([(0, "litigation"), (0, "risk")], "qid int, term string")
    best = retrieval.bm25(docs, terms, "id").orderBy(F.desc("bm25")).first()
    assert best.id == "b" and best.bm25 > 0
    top = retrieval.hybrid(docs, terms, "id", 2).orderBy("final_rank").collect()
    assert len(top) == 2 and top[0].id in ("a", "b")
    none = retrieval.hybrid(docs, terms.limit(0), "id", 3).orderBy("final_rank").collect()
    assert [r.id for r in none] == ["a", "b", "c"]  # without query words the dense order stays


def test_rrf_identity(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "b", 1), (0, "a", 2), (0, "", 3), (0, None, 4)], "qid int, id string, rank long")
    got = {r.id: r.rrf for r in retrieval.rrf(ranked, "id").collect()}
    assert set(got) == {"a", "b"} and got["a"] == got["b"] == round(1 / 61 + 1 / 62, 6)


@pytest.mark.parametrize("q,year,form", [("AAPL 2024 10-Q risk", 2024, "10-Q"), ("in 2023?", 2023, None), ("the 10-K and 10-Q", None, "10-K"), ("none", None, None)])
def test_question_filter(spark, q, year, form):
    y, f = retrieval.question_filter(F.lit(q))
    assert tuple(spark.range(1).select(y, f).first()) == (year, form)


def test_filter_algebra_before_top_k(spark):
    df = spark.createDataFrame([(1, 2020, "10-K"), (2, 2022, "10-K"), (3, 2023, "8-K")], "id int, year int, form string")
    spec = {"$and": [{"year": {"$gte": 2021, "$lte": 2023}}, {"form": "10-K"}]}
    assert rows(df.where(retrieval.metadata_filter(spec)).select("id")) == [(2,)]
    assert df.where(retrieval.metadata_filter(None)).count() == 3
    d = spark.createDataFrame([(1, None), (2, "2024-01-01")], "id int, date string")
    assert rows(d.where(retrieval.date_filter(F.col("date"), start="2023")).select("id")) == [(2,)]
    assert d.where(retrieval.date_filter(F.col("date"), end="2025")).count() == 2


def test_windows_rebuild_the_words(spark):
    for n in (0, 1, 449, 450, 451, 820, 821, 1200):
        df = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "id int, text string")
        got = chunking.word_windows(df, ["id"]).orderBy("idx").collect()
        words = []
        for r in got:
            assert r.start == r.idx * 370 and r.n_words <= 450
            words[r.start :] = r.chunk.split(" ")
        assert words == [str(i) for i in range(n)]
        assert len(got) == (0 if n == 0 else 1 if n <= 450 else -(-(n - 450) // 370) + 1)


def test_packed_paragraphs(spark):
    df = spark.createDataFrame([(1, "a" * 900 + "\n\n" + "b" * 900 + "\n\n" + "c" * 2000), (2, None), (3, " \n\n ")], "id int, text string")
    got = chunking.packed_paragraphs(df, ["id"]).orderBy("idx").collect()
    assert [r.chunk for r in got] == ["a" * 900, "a" * 200 + "\n\n" + "b" * 900, "b" * 200 + "\n\n" + "c" * 2000]


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, "x" * 5), (2, "x" * 8), (3, "x")], "rank int, text string")
    assert [r.rank for r in relational.budget(df, [], [F.col("rank")], "text", 10).collect()] == [1]


def test_budget_of_shares_equals_one_list(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), None if r.random() < 0.1 else "x" * r.choice([0, 1, 3, 30, 90])) for i in range(300)]
    want = []
    for g in "ab":
        total = 0
        for i, _, t in (x for x in rows if x[1] == g):
            total += len(t or "")
            if total > 100:
                break
            want.append(i)
    for shares in (1, 7):
        df = spark.createDataFrame(r.sample(rows, len(rows)), "i int, g string, text string").repartition(shares)
        assert sorted(x.i for x in relational.budget(df, ["g"], [F.col("i")], "text", 100).collect()) == sorted(want)


@pytest.mark.parametrize("least", [0.2, 0.6, 1.0])
def test_similar_pairs_equal_all_pairs(spark, least):
    r = random.Random(9)
    sets = {(g, i): {f"w{r.randrange(9)}" for _ in range(r.randrange(7))} for g in range(4) for i in range(25)}
    rows = [(g, i, [*s, *sorted(s)[:1]] if s or i % 2 else None) for (g, i), s in sets.items()]
    df = spark.createDataFrame(rows, "g int, i int, words array<string>")
    got = sorted((x.g, x.i, x.j) for x in relational.similar_pairs(df, "g", "i", "words", least).collect())
    want = [(g, i, j) for (g, i), s in sets.items() for (h, j), t in sets.items() if g == h and i < j and s and t and len(s & t) / len(s | t) >= least]
    assert got == sorted(want) and got


def test_similar_pairs_of_a_group_in_tiles(spark):
    """A group of several blocks has the pairs of all its blocks, each once."""
    r = random.Random(4)
    sets = {(g, i): {f"w{r.randrange(12)}" for _ in range(r.randrange(9))} for g, n in ((1, 70), (2, 3), (3, 16)) for i in range(n)}
    df = spark.createDataFrame([(g, i, sorted(s)) for (g, i), s in sets.items()], "g int, i int, words array<string>")
    got = sorted((x.g, x.i, x.j) for x in relational.similar_pairs(df, "g", "i", "words", 0.4, tile=8).collect())
    assert got == sorted((g, i, j) for (g, i), s in sets.items() for (h, j), t in sets.items() if g == h and i < j and s and t and len(s & t) / len(s | t) >= 0.4)


def test_similar_pairs_send_a_set_once(spark):
    """A set of many words does not travel with each of them."""
    c = spark.range(40).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
    c = c.withColumn("words", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda w: F.concat(F.lit("w"), (w + 7 * F.col("i")).cast("string"))))
    found = relational.similar_pairs(c, "g", "i", "words", 0.2)
    assert found.count() == 40
    p = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(slice" not in p and "_word" not in p


def test_dense_many_equals_all_pairs(spark):
    """Floors from a part of the vectors lose nothing: ties, zero, null, broken and shorter vectors, long ones on arrays."""
    r = random.Random(3)
    for d, n in ((3, 400), (retrieval.UNROLLED + 1, 70)):
        data = [(i, [float(r.randrange(-2, 3)) for _ in range(d)]) for i in range(n)] + [(n, None), (n + 1, [1.0, None, *[0.0] * (d - 2)]), (n + 2, [0.0] * d)]
        v = spark.createDataFrame(data, "id int, embedding array<double>")
        q = v.where("id % 9 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
        got = [(x.qid, x.id, x.score, x.rank) for x in retrieval.dense_many(v, q, 4, "id").orderBy("qid", "rank").collect()]
        score = F.round(dot(unit(F.col("embedding")), unit(F.col("query"))), 6)
        want = relational.top_per(v.crossJoin(q).select("qid", "id", score.alias("score")), ["qid"], [F.desc("score"), F.col("id")], 4)
        assert got == [(x.qid, x.id, x.score, x.rank) for x in want.orderBy("qid", "rank").collect()] and got


def test_dense_many_walks_no_arrays_per_pair(spark):
    """Pairs are compiled products of columns, and those below a question's floor are dropped before any sort."""
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id int, embedding array<double>")
    p = retrieval.dense_many(v, v.select(F.col("id").alias("qid"), F.col("embedding").alias("query")), 2, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in p and "_floor" in p


def test_carried_levels_reset(spark):
    lines = [(1, "P1", None), (2, None, "I1"), (3, None, None), (4, "P2", None), (5, None, None), (6, None, "I2")]
    df = spark.createDataFrame([("d", *x) for x in lines], "doc string, i int, p string, t string")
    got = relational.carried(df, ["doc"], "i", [("part", F.col("p")), ("item", F.col("t"))]).orderBy("i").collect()
    assert [(r.part, r.item) for r in got] == [("P1", None), ("P1", "I1"), ("P1", "I1"), ("P2", None), ("P2", None), ("P2", "I2")]


def test_upsert_is_idempotent_and_partitions_do_not_matter(spark):
    old = spark.createDataFrame([(i, "old") for i in range(20)], "id int, v string")
    new = spark.createDataFrame([(i, "new") for i in range(10, 30)], "id int, v string")
    once = relational.upsert(old, new, ["id"])
    assert rows(relational.upsert(once, new, ["id"])) == rows(once) and once.count() == 30
    for n in (1, 7):
        assert rows(relational.keep_first(once.union(old).repartition(n), ["id"], ["v"])) == rows(relational.keep_first(once.union(old), ["id"], ["v"]))


def test_board_members(spark):
    data = [("aapl", 2023, "Art Levinson", "Chair", 1), ("aapl", 2024, "Art Levinson Board Chair", "Board Chair", 2), ("aapl", 2024, "Tim Cook", "CEO", 3), ("aapl", 2025, "Tim Cook", "CEO", 4), ("aapl", 2025, "Director", "x", 5)]
    got = {r.name: r for r in graph.board_members(spark.createDataFrame(data, "ticker string, year int, name string, title string, pos int")).collect()}
    assert set(got) == {"Art Levinson", "Tim Cook"}
    assert got["Art Levinson"].years_present == [2023, 2024] and got["Art Levinson"].title == "Board Chair" and not got["Art Levinson"].is_current and got["Tim Cook"].is_current


def test_subsidiary_edges_and_patents(spark):
    p = spark.createDataFrame([("aapl", "Apple", "10-K", [(2023, "a", "u", ["One Ltd.", "Two"]), (2024, "b", "u", ["One Ltd.", " "])])], "ticker string, company_title string, form_type string, subsidiaries_by_year array<struct<year:int,accession:string,exhibit_21_url:string,subsidiaries:array<string>>>")
    assert rows(graph.subsidiary_edges(p).select("subsidiary_id", "year")) == [("AAPL_one_ltd", 2023), ("AAPL_one_ltd", 2024), ("AAPL_two", 2023)]
    csv = spark.createDataFrame([("1", "2020-01-01", "Apple Inc."), ("2", "2021-05-01", "apple inc."), ("3", "2025-01-01", ""), ("4", "2026-01-01", "Apple Inc."), ("5", "2024-01-01", "Other"), ("6", "bad", "Apple Inc.")], "patent_id string, grant_date string, assignee_organization string")
    assert [r.patent_id for r in graph.patents_in_scope(csv, "Apple Inc.").orderBy("patent_id").collect()] == ["2", "3"]


@pytest.mark.parametrize("q,ok", [("MATCH (c:Company) RETURN c", True), ("MATCH (c) DELETE c RETURN c", False), ("RETURN 1", False), ("MATCH (c) RETURN c; MATCH (d) RETURN d", False), ("MATCH (n) WHERE n.offset = 1 RETURN n", True)])
def test_read_only_guard(spark, q, ok):
    assert spark.range(1).select(graph.is_read_only(F.lit(q))).first()[0] is ok


def test_sections_of_a_filing(spark):
    from siltstone import schemas

    body = "A body block that is certainly longer than fifty characters in all."
    blocks = [("Market Risk", "body", "#/texts/1", None), ("Foreign Currency Risk", "body", "#/texts/2", None), ("Item 7. Contents", "body", "#/texts/3", "#toc"), ("Apple Inc. | 2021 Form 10-K | 7", "body", "#/texts/4", None), (body, "body", "#/texts/12", None), (body + " two", "body", None, None), (body + " three", "body", "#/texts/1", None)]
    entry = ("f.json", "aapl", None, "10-K", "2021-09-25", None, "Apple", ([(t, "text", layer, ref, link) for t, layer, ref, link in blocks], [], ("f",)))
    got = chunking.sections(spark.createDataFrame([entry], schemas.DOCLING)).orderBy("ordinal").collect()
    assert [(r.section_id, r.title) for r in got] == [("AAPL_10-K_2021_section_1", None), ("AAPL_10-K_2021_section_2", None), ("AAPL_10-K_2021_section_12", "Foreign Currency Risk")]


def test_tree_build_and_seeded_defects(spark):
    from siltstone.plans.models import first_sentences

    leaves = spark.createDataFrame([(f"n{i:02d}", f"Leaf {i} says this. More.", "doc") for i in range(12)], "id string, text string, source_doc_id string")
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    by_hash = lambda df: df.withColumn("cluster", F.pmod(F.xxhash64("id"), F.lit(5)).cast("int"))
    t = tree.build(leaves, embed, first_sentences, clusterer=by_hash)
    t = spark.createDataFrame(t.collect(), t.schema)
    assert not tree.issues(t).count() and tree.is_ready(t)
    assert t.where("node_type = 'leaf' and parent_id is null").count() == 0
    top = t.where("node_type = 'summary'").orderBy("id").first().id
    bad = t.withColumn("text", F.when(F.col("id") == top, " ").otherwise(F.col("text"))).where("id <> 'n03'")
    assert {r.issue for r in tree.issues(bad).collect()} == {"missing_child", "empty_summary"}


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string")
    assert sorted(r.path for r in graph.cycles(e).collect()) == [["a", "b", "c"], ["d"]]


@pytest.mark.parametrize("n,m,seed", [(12, 132, 0), (30, 45, 1), (40, 60, 2)])
def test_rings_of_random_graphs(spark, n, m, seed):
    """Components against reachability; every ring is one, every component that has rings has one, and no more than edges."""
    import itertools
    import random

    every = list(itertools.permutations(range(n), 2))
    edges = set(random.Random(seed).sample(every, min(m, len(every))))
    reach = {i: {i} for i in range(n)}
    while True:
        new = {i: r | {b for a in r for x, b in edges if x == a} for i, r in reach.items()}
        if new == reach:
            break
        reach = new
    parts = {frozenset(j for j in reach[i] if i in reach[j]) for i in range(n)}
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src int, dst int")
    got = {}
    for r in graph.strong_components(df).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(x) for x in got.values()} == {p for p in parts if len(p) > 1} and all(min(x) == k for k, x in got.items())
    rings = [tuple(r.path) for r in graph.cycles(df).collect()]
    assert len(rings) == len(set(rings)) <= len(edges)
    for ring in rings:
        assert len(set(ring)) == len(ring) and ring[0] == min(ring) and all(e in edges for e in zip(ring, [*ring[1:], ring[0]]))
    assert all(any(set(ring) <= p for ring in rings) for p in parts if len(p) > 1)


def test_patterns_are_reduced_before_they_are_joined(spark):
    import random

    r = random.Random(5)
    make = lambda n, a, b, k: spark.createDataFrame([(r.randrange(k), r.randrange(k)) for _ in range(n)] + [(None, 1), (1, None)], f"{a} int, {b} int")
    tables = {"m": make(40, "m1", "m2", 8), "x": make(60, "x1", "x2", 12), "y": make(50, "y1", "y2", 9), "z": make(30, "z1", "z2", 15)}
    links = [("m", "m1", "x", "x1"), ("y", "y2", "m", "m2"), ("x", "x2", "z", "z1")]
    plain = tables["m"].join(tables["x"], F.expr("m1 = x1")).join(tables["y"], F.expr("y2 = m2")).join(tables["z"], F.expr("x2 = z1"))
    got = graph.matched(tables, links)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    few = graph.matched(tables, links, ["y1", "z2"], distinct=True)
    assert sorted(map(str, few.collect())) == sorted(map(str, plain.select("y1", "z2").distinct().collect()))
    for name, t in graph.reduced(tables, links).items():  # every row left is in a match
        assert t.exceptAll(plain.select(*t.columns)).distinct().join(plain.select(*t.columns).distinct(), t.columns, "left_anti").count() == 0, name
    # a join of the first two tables would give a million rows, none of which goes on
    hot = {"a": spark.range(1000).select(F.lit(1).alias("a1"), F.col("id").alias("a2")), "b": spark.range(1000).select(F.lit(1).alias("b1"), F.col("id").alias("b2")), "c": spark.range(5000, 5010).select(F.col("id").alias("c1"))}
    small = graph.reduced(hot, [("a", "a1", "b", "b1"), ("b", "b2", "c", "c1")])
    assert all(t.count() == 0 for n, t in small.items())
    for bad in ([("m", "m1", "x", "x1")], [*links, ("z", "z2", "m", "m2")]):
        with pytest.raises(ValueError):
            graph.matched(tables, bad)


def test_branches_of_a_pattern_come_down_to_their_wanted_columns(spark):
    """Two branches that meet at a hot row do not multiply: each is distinct in what is wanted of it before they meet."""
    import re

    one = spark.range(1).select(F.col("id").alias("r1"))
    a = spark.range(3000).select(F.lit(0).cast("long").alias("a1"), (F.col("id") % 5).alias("a2"))
    b = spark.range(3000).select(F.lit(0).cast("long").alias("b1"), F.col("id").alias("b2"))
    c = spark.range(3000).select(F.col("id").alias("c1"), (F.col("id") % 3).alias("c2"))
    got = graph.matched({"r": one, "a": a, "b": b, "c": c}, [("r", "r1", "a", "a1"), ("r", "r1", "b", "b1"), ("b", "b2", "c", "c1")], ["a2", "c2"], distinct=True)
    assert sorted(map(tuple, got.collect())) == [(x, y) for x in range(5) for y in range(3)]
    assert re.search(r"Aggregate \[b1#\d+L?, c2#\d+L?\]", got._jdf.queryExecution().analyzed().toString().replace("Deduplicate", "Aggregate"))


def test_cache_gate_and_hit(spark):
    assert spark.range(1).select(cache.is_time_sensitive(F.lit("What do you know?"))).first()[0] is True  # "now" inside "know"
    r = spark.createDataFrame([("graph", "a"), ("sql", "b"), ("sql", "latest c")], "route string, question string")
    assert rows(cache.storable(r).select("question")) == [("b",)]


@pytest.mark.parametrize("q,route", [
    ("Who are the board members of Apple?", "graph"), ("List Apple subsidiaries", "graph"), ("What was total revenue?", "sql"), ("Compare the earnings call vs the 10-K", "contradiction"),
    ("Which patent mentions optics", "patents"), ("Any lawsuit pending", "litigation"), ("hello there", "llm_direct"), ("the corporation", "sql"), ("item 1a text", "filings"), ("what guidance was given", "transcripts"),
])
def test_routes(spark, q, route):
    assert spark.range(1).select(planner.route_hint(F.lit(q))).first()[0] == route


def test_subquestions(spark):
    qs = spark.createDataFrame([(1, "What was revenue? Which patents exist?"), (2, "What was revenue?"), (3, "Compare revenue vs the earnings call and 10-K risk factor")], "qid int, question string")
    got = {}
    for r in planner.subquestions(qs).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.subquestion, r.route, r.plan))
    assert got[1] == [("What was revenue", "sql", "multi"), ("Which patents exist", "patents", "multi")]
    assert got[2] == [("What was revenue?", "sql", "single")]
    assert [x[1] for x in got[3]] == ["sql", "filings", "transcripts", "contradiction"]


@pytest.mark.parametrize("args,then", [((2, "filings", False, 0), "generate"), ((0, "filings", False, 0), "graph_fallback"), ((0, "filings", True, 1), "rewrite"), ((0, "graph", True, 0), "end"), ((0, "sql", False, 3), "web_search")])
def test_branches(spark, args, then):
    assert spark.range(1).select(planner.after_grading(*map(F.lit, args))).first()[0] == then


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, True), (3, 1, False), (3, 2, False), (4, 1, True)], "qid int, rank int, relevant boolean")
    assert rows(evaluation.mrr(ranked)) == [(1, 1.0), (2, 0.5), (3, 0.0), (4, 1.0)]
    assert rows(evaluation.ndcg(ranked, 3)) == [(1, 1.0), (2, 0.63093), (3, 0.0), (4, 1.0)]
    one = lambda c: spark.range(1).select(c).first()[0]
    nums = lambda *x: F.array(*map(F.lit, x))
    assert one(evaluation.numerical_accuracy(F.lit("$391.0 billion"), nums(391.0))) == 1.0
    assert one(evaluation.numerical_accuracy(F.lit("392"), nums(391.0))) == 1.0
    assert one(evaluation.numerical_accuracy(F.lit("300"), nums(391.0))) == 0.0
    assert one(evaluation.numerical_accuracy(F.lit("300"), F.lit(None).cast("array<double>"))) == 1.0
    assert one(evaluation.entity_presence(F.lit("Apple and Tim Cook"), nums("apple", "x", "y"))) == pytest.approx(1 / 3)
    assert one(evaluation.citation_overlap(nums("A"), nums("a"))) == 1.0


def test_sweep(spark):
    f = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 5.0)], "k string, figure double")
    s = spark.createDataFrame([("a", 100.0), ("b", 10.0), ("d", 5.0)], "k string, statement double")
    got = {r.k: (r.score, r.severity, r.detected) for r in contradiction.sweep(f, s, ["k"]).collect()}
    assert got == {"a": (0, "low", False), "b": (9, "critical", True), "c": (0, "low", False), "d": (0, "low", False)}
    q = contradiction.questions(spark.createDataFrame([("Apple Inc.", 2024, "Q4")], "company string, fiscal_year int, quarter string"))
    assert q.count() == 6 and q.where("figure_question like '%Apple Inc.%fiscal Q4 2024%'").count() == 6


def test_table_rows(spark):
    cells = [(0, 0, ""), (0, 1, ""), (1, 0, "Year"), (1, 1, ""), (2, 0, "2024"), (2, 1, "5")]
    got = chunking.table_rows(spark.createDataFrame([("t", *c) for c in cells], "t string, r int, c int, text string"), ["t"]).collect()
    assert [[(x.name, x.value) for x in r.cells] for r in got] == [[("Year", "2024"), ("col_1", "5")]]
