"""Physical plans: filters and column choices reach the scan, hot paths stay on the JVM, shuffles are as few as meant."""

import os
import re

import pytest

from siltstone.plans import boundary, catalog, indexed, injected, pages, streams  # noqa: F401  the others register their queries in the catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_pushed_down(spark):
    p = plan(catalog.dense_topk_filtered(spark, DATA))
    assert "EqualTo(label,3)" in p and "GreaterThanOrEqual(vec_id,0)" in p
    p = plan(catalog.substring_filter(spark, DATA))
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in p


def test_only_needed_columns_are_read(spark):
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.fact_filing_join(spark, DATA)))
    assert sorted(r.count(":") for r in reads) == [2, 2]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(catalog.doc_hash_dedupe(spark, DATA))


#: What built-in functions cannot say: parsers of HTML, a source that pages through a REST search, injected models; blocks of
#: vectors and questions as matrices.
PYTHON = {"html_text", "html_tables", "inline_xbrl", "rest_search", "judged_answers", "page_blocks", "page_tables", "embedded_turns", "retried_models", "indexed_search", "corpus_retrieval", "semantic_cache_live"}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_python_on_the_executors(spark, name):
    """Only the named queries run Python there, and these in Arrow batches, never row by row."""
    p = plan(catalog.QUERIES[name](spark, DATA))
    assert bool(re.search(r"Python|Pandas|ArrowEval|MapInArrow|BatchScan", p)) == (name in PYTHON)
    assert "BatchEvalPython" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("name,most", [("keep_first", 1), ("upsert_latest", 1), ("word_window_chunks", 0), ("route_hint", 0), ("top_per_group", 1), ("audit_routes", 1), ("semantic_cache_lookup", 3), ("doc_hash_dedupe", 1)])
def test_shuffles(spark, name, most):
    assert len(re.findall(r"Exchange hashpartitioning", plan(catalog.QUERIES[name](spark, DATA)))) <= most


def test_top_k_is_cut_before_it_is_merged(spark):
    assert "TakeOrderedAndProject" in plan(catalog.dense_topk(spark, DATA))
    assert "WindowGroupLimit" in plan(catalog.top_per_group(spark, DATA))


def test_graph_questions(spark):
    from siltstone.plans import nlgraph

    nodes = {"Company": spark.createDataFrame([("c1", "AAPL", "Apple Inc."), ("c2", "MSFT", "X")], "id string, ticker string, name string"), "Subsidiary": spark.createDataFrame([(f"s{i}", f"Sub {i}") for i in range(30)], "id string, name string")}
    edges = {"HAS_SUBSIDIARY": ("Company", "Subsidiary", spark.createDataFrame([("c1", f"s{i}", 2020 + i % 5) for i in range(20)] + [("c2", f"s{i}", 2024) for i in range(20, 25)], "src string, dst string, year int"))}
    asked = []

    def model(said):
        asked.append(said)
        return "```cypher\nMATCH (c:Company {ticker: 'AAPL'})-[r:HAS_SUBSIDIARY]->(s:Subsidiary) WHERE r.year = 2024 AND s.name CONTAINS 'Sub' RETURN DISTINCT c.name AS company, s.name AS subsidiary, r.year AS year ORDER BY subsidiary\n```"

    _, got = nlgraph.ask("Which subsidiaries?", nodes, edges, model, ticker="aapl")
    assert [r.subsidiary for r in got.collect()] == ["Sub 14", "Sub 19", "Sub 4", "Sub 9"] and "Ticker: AAPL" in asked[0] and "HAS_SUBSIDIARY {year}" in asked[0]
    assert nlgraph.run("MATCH (s:Subsidiary) RETURN s.name", nodes, edges).count() == 10
    assert nlgraph.run("MATCH (s:Subsidiary)<-[:HAS_SUBSIDIARY]-(c:Company) RETURN s.name LIMIT 3", nodes, edges).count() == 3
    o = nlgraph.run("MATCH (c:Company {ticker: 'MSFT'}) OPTIONAL MATCH (c:Company)-[r:HAS_SUBSIDIARY {year: 2020}]->(s:Subsidiary) RETURN c.ticker AS t, s.name AS n", nodes, edges)
    assert [tuple(r) for r in o.collect()] == [("MSFT", None)]
    for bad in ("MATCH (c:Company) DELETE c", "MATCH (c:Company) RETURN c.id; MATCH (c:Company) RETURN c.id", "RETURN 1"):
        with pytest.raises(nlgraph.NotReadOnly):
            nlgraph.run(bad, nodes, edges)
    with pytest.raises(nlgraph.BadPattern):
        nlgraph.run("MATCH (p:Person) RETURN p.id", nodes, edges)


def test_a_models_plan_holds_unless_its_parts_say_the_same(spark):
    from siltstone.plans import planner

    q = spark.createDataFrame([(1, "Compare what management said on the earnings call vs the 10-K filing on revenue?"), (2, "Compare guidance on the earnings call vs the 10-K?"), (3, "What is revenue?")], "qid long, question string")
    m = spark.createDataFrame([(1, 0, "What did the CEO say about revenue?", "transcripts"), (1, 1, "What does the 10-K disclose on risk?", None), (2, 0, "What was the guidance given", "transcripts"), (2, 1, "What guidance was given", "filings"), (3, 0, "Revenue this year", "sql"), (3, 1, "Risk", "filings")], "qid long, pos long, subquestion string, route string")
    got = {}
    for r in planner.planned(q, m).collect():
        got.setdefault(r.qid, []).append((r.pos, r.subquestion, r.route, r.plan))
    assert sorted(got[1]) == [(0, "What did the CEO say about revenue", "transcripts", "multi"), (1, "What does the 10-K disclose on risk", "filings", "multi")]
    assert all(s not in ("What was the guidance given", "What guidance was given") for _, s, _, _ in got[2]) and got[3] == [(0, "What is revenue?", "sql", "single")]
