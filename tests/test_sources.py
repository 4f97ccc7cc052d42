"""Scans, HTML, sinks, streaming and SQL guard on small files."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators import relational
from siltstone.plans import nlsql
from siltstone.plans.engine import Engine
from siltstone.plans.models import Models, batched, hashed_embedding, with_retries
from siltstone.sources.keyed import KeyedTable
from siltstone.sources import filings, html, sinks
from siltstone.streaming import audit_stream


def test_filings_and_facts(spark, tmp_path):
    (tmp_path / "sub.txt").write_text("adsh\tcik\tname\tform\tperiod\tfy\tfp\tfiled\textra\na1\t320193\tAPPLE\t10-K\t20240928\t2024\tFY\t20241101\tx\na2\t1\tB\t10-Q\t\t\tQ1\tbad\ty\n")
    (tmp_path / "num.txt").write_text("adsh\ttag\tversion\tddate\tqtrs\tuom\tvalue\na1\tRevenues\tus\t20240928\t4\tUSD\t391.5\na2\tAssets\tus\t20240928\t0\tUSD\t\n")
    f, n = filings.filings(spark, str(tmp_path / "sub.txt")), filings.facts(spark, str(tmp_path / "num.txt"))
    assert f.columns == [x.name for x in schemas.struct(schemas.FILINGS)]
    a, b = f.orderBy("adsh").collect()
    assert a.fiscal_year == 2024 and str(a.filed) == "2024-11-01" and a.sic is None and b.filed is None and b.fiscal_year is None
    _, kept = filings.facts_of(n, f, [320193])
    assert [(r.adsh, r.value) for r in kept.collect()] == [("a1", 391.5)]


def test_patents(spark, tmp_path):
    (tmp_path / "g_patent.tsv").write_text("patent_id\tpatent_date\tpatent_title\np1\t2022-01-04\tOne\np2\t2019-01-01\tTwo\np3\t2023-01-01\tThree\n")
    (tmp_path / "g_assignee.tsv").write_text("patent_id\tassignee_id\tdisambig_assignee_organization\np1\tx\tApple Inc.\np2\tx\tApple Inc.\np3\ty\tOther\n")
    (tmp_path / "g_cpc.tsv").write_text("patent_id\tcpc_group\np1\tH04L9/32\np1\tA61B5/02\np1\tH04L9/32\np3\tG06F\n")
    (tmp_path / "g_claims.tsv").write_text("patent_id\tclaim_number\tclaim_text\tdependent\np1\t1\tA device\t\np1\t2\tThe device of 1\t1\np1\t3\t \t0\n")
    t = filings.patents(spark, str(tmp_path), "x", "2021-01-01", "2025-12-31")
    p = filings.merged_patents(t).collect()
    assert [(r.patent_id, r.assignee_organization, r.cpc_codes) for r in p] == [("p1", "Apple Inc.", ["A61B5/02", "H04L9/32"])]
    assert [r.claim_number for r in filings.independent_claims(t["claims"]).collect()] == [1]


def test_submissions(spark, tmp_path):
    recent = {"accessionNumber": ["a", "b", "c"], "filingDate": ["2024-02-01", "2025-11-01", "2024-05-02"], "reportDate": ["", "2024-09-28", "2024-05-02"], "form": ["8-K", "DEF 14A", "8-K"], "items": ["2.02,9.01", "", "5.02"], "primaryDocument": ["x", "y", "z"]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "320193", "name": "Apple", "filings": {"recent": recent}}))
    s = filings.submissions(filings.json_rows(spark, str(tmp_path / "s.json"), schemas.SUBMISSIONS))
    assert [(r.accessionNumber, r.year, r.cik) for r in s.orderBy("pos").collect()] == [("a", 2024, "0000320193"), ("b", 2024, "0000320193"), ("c", 2024, "0000320193")]
    assert [r.accessionNumber for r in filings.earnings_releases(s, "2024-01-01", "2024-12-31").collect()] == ["a"]
    assert [r.accessionNumber for r in filings.annual(s, "DEF 14A").collect()] == ["b"]
    (tmp_path / "i.json").write_text(json.dumps({"directory": {"item": [{"name": "a.htm", "type": "10-K"}, {"name": "aapl-ex21_1.htm", "type": "EX-21.1"}]}}))
    assert filings.exhibit_21(filings.json_rows(spark, str(tmp_path / "i.json"), schemas.FILING_INDEX)).first().exhibit == "aapl-ex21_1.htm"


def test_company_resolution(spark):
    c = spark.createDataFrame([("AAPL", "Apple Inc."), ("APLE", "Apple Hospitality"), ("MSFT", "Microsoft Corp")], "ticker string, title string")
    n = spark.createDataFrame([("aapl",), ("apple inc",), ("Hospitality",), ("nobody",)], "name string")
    assert {r.name: r.ticker for r in filings.resolved(n, c).collect()} == {"aapl": "AAPL", "apple inc": "AAPL", "Hospitality": "APLE"}


PAGE = """<html><head><style>x</style><script>y</script></head><body><p>One</p><p>Two &amp; three</p>
<table><tr><td>Name of Subsidiary</td></tr><tr><td>Alpha Ltd</td></tr><tr><td>ALPHA LTD</td></tr><tr><td>Beta</td></tr><tr><td>99</td></tr></table>
<table><tr><th>Director</th><th>Position</th></tr><tr><td>Ann Lee</td><td>Chair</td></tr><tr><td>Ann Lee</td><td>Chair</td></tr><tr><td>Bo Van Dyk</td><td>Member</td></tr></table>
<table><tr><td>1</td><td>x</td><td><a href="/e.htm">e</a></td><td>EX-99.1</td></tr></table></body></html>"""


def test_html():
    assert html.text_of(PAGE).startswith("One") and "y" not in html.text_of(PAGE).split("\n")[:3] and html.text_of("<p> </p>") is None
    assert html.subsidiary_names(PAGE)[:2] == ["Alpha Ltd", "Beta"]
    assert html.directors(PAGE) == [("Ann Lee", "Chair"), ("Bo Van Dyk", "Member")]
    assert html.exhibit_link(PAGE) == "/e.htm"


def test_text_keeps_incomplete_references():
    """A reference that a cut has left without its semicolon stays as it is written, as does an unknown name."""
    assert html.text_of("<title>a&amp;&amp</title><p>&amp;amp &quot;x&quo &copy &notit; &#65;&#66 &x</p>") == 'a&&amp\n\n&amp "x&quo &copy &notit; A&#66 &x'


XBRL = """<ix:header><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2023-10-01</xbrli:startDate><xbrli:endDate>2024-09-28</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:segment><xbrldi:explicitMember dimension="srt:ProductAxis">aapl:IPhone</xbrldi:explicitMember></xbrli:segment><xbrli:instant>2024-09-28</xbrli:instant></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:header>
<p>Sales <ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="usd" scale="6">391,035</ix:nonFraction> <ix:nonFraction name="us-gaap:Revenues" contextRef="c1">391,035</ix:nonFraction>
<ix:nonFraction name="us-gaap:Assets" contextRef="c2" xsi:nil="true"></ix:nonFraction><ix:nonNumeric name="us-gaap:PolicyTextBlock" contextRef="c1">text</ix:nonNumeric><ix:nonNumeric name="dei:Name" contextRef="c2">Apple</ix:nonNumeric></p>"""


def test_inline_xbrl(spark):
    pages = spark.createDataFrame([("f", XBRL), ("g", None)], "source string, html string")
    raw = html.xbrl_facts(pages, ["source"])
    assert raw.count() == 5
    got = {r.tag: r for r in filings.cleaned_facts(raw).collect()}
    assert set(got) == {"us-gaap:Revenues", "dei:Name"}
    r = got["us-gaap:Revenues"]
    assert (r.value_num, r.unit, r.period_type, r.period_label, r.fiscal_quarter) == (391035.0, "USD", "annual", "FY", None)
    assert got["dei:Name"].instant == "2024-09-28" and got["dei:Name"].dimension == "srt:ProductAxis"
    assert html.without_xbrl(XBRL).strip().startswith("<p>Sales 391,035")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    with pytest.raises(sinks.MissingColumns):
        sinks.append(df, str(tmp_path / "t"), ["id", "w"])
    p = str(tmp_path / "u")
    back = sinks.insert_absent(df, p, ["id"])
    again = sinks.insert_absent(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), p, ["id"])
    assert back.count() == 2 and sorted(map(tuple, again.collect())) == [(2, "b"), (3, "d")] and KeyedTable(spark, p, ["id"]).read().count() == 3
    root = str(tmp_path / "pub")
    kids = spark.createDataFrame([(1, 9), (7, 9)], "ref int, x int")
    with pytest.raises(ValueError):
        sinks.publish({"parent": df, "kids": kids}, root, [("kids", "ref", "parent", "id")])
    sinks.publish({"parent": df, "kids": kids.where("ref = 1")}, root, [("kids", "ref", "parent", "id")])
    sinks.publish({"parent": df.limit(1), "kids": kids.where("ref = 1")}, root)
    assert sinks.read_published(spark, root, "parent").count() == 1 and sinks.read_published(spark, root, "kids").count() == 1
    assert sinks.publish({"parent": df}, root) == 3 and sinks.read_published(spark, root, "kids").count() == 1
    for _ in range(3):
        sinks.publish({"kids": kids}, root)
    assert sinks.read_published(spark, root, "parent").count() == 2 and sinks.read_published(spark, root, "kids").count() == 2
    v = spark.createDataFrame([("n", "1", "x", 1), ("n", "1", "y", 2)], "namespace string, id string, v string, seq int")
    assert [r.v for r in sinks.upsert_vectors(v.where("seq = 1"), v, "seq").collect()] == ["y"]
    sinks.json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1}'


def test_sql_guard_and_retry(spark):
    spark.range(30).createOrReplaceTempView("numbers_view")
    asked = []

    def model(question, error):
        asked.append(error)
        return "```sql\nSELECT idd FROM numbers_view;\n```" if error is None else "SELECT id FROM numbers_view"

    sql, got = nlsql.ask(spark, "all?", model)
    assert got.count() == 20 and asked[0] is None and "idd" in asked[1]
    for bad in ("DROP TABLE numbers_view", "SELECT 1; SELECT 2", "INSERT INTO numbers_view SELECT 1"):
        with pytest.raises(nlsql.NotReadOnly):
            nlsql.ask(spark, "x", lambda q, e, bad=bad: bad)


def test_streaming_windows_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:10:00", "view" if i % 2 else "click", float(i)) for i in range(40)] + [(99, "2024-01-03 00:00:00", "view", 0.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.union(df.where("event_id < 5")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = audit_stream.windowed(audit_stream.events(spark, str(tmp_path / "in"), df.schema))
    audit_stream.to_table(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = df.where("event_id < 99").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0] == 40


def test_models(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id int, text string")
    assert {r.n for r in batched(df, "text", lambda xs: [len(x) for x in xs], "n", "long", 2).collect()} == {6}
    calls = []

    def fails(x):
        calls.append(x)
        raise RuntimeError("busy")

    assert with_retries([fails, str.upper], sleep=lambda s: None)("a") == "A" and len(calls) == 3
    assert len(df.select(hashed_embedding(F.col("text")).alias("v")).first().v) == 64


def test_engine_end_to_end(spark):
    texts = [("filings", "f1", "Apple net sales grew in 2024 on services revenue"), ("filings", "f2", "Risk factor: supply chain litigation"), ("filings", "f3", "The weather was mild"), ("patents", "p1", "A patent for optics and lenses")]
    v = spark.createDataFrame([(n, i, t, "2024-01-01", "leaf") for n, i, t in texts], "namespace string, id string, text string, date string, node_type string").withColumn("embedding", hashed_embedding(F.col("text")))
    e = Engine(spark, v, Models())
    got = e.retrieve("services revenue of Apple", "filings").orderBy("final_rank").collect()
    assert got[0].id == "f1" and len(got) == 3
    assert e.retrieve("optics patent", "patents", start="2025-01-01").count() == 0
    a = e.query("services revenue of Apple").first()
    assert "services revenue" in a.answer and a.citations == ["f1"] and a.cache_hit is False
    edges = spark.createDataFrame([("s", "f1", 0)], "parent_id string, child_id string, pos int")
    assert e.raptor_retrieve("services revenue", edges).count() == 3
    assert relational.missing_columns(v, ["id", "nope"]) == ["nope"]


def test_publish_loses_nothing_when_the_last_step_fails(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    root, df = str(tmp_path / "pub"), spark.createDataFrame([(1, "a")], "id int, v string")
    sinks.publish({"a": df, "b": df}, root)

    def fails(*_):
        raise OSError("no link")

    with monkeypatch.context() as m:
        m.setattr(sinks, "place_once", fails)
        with pytest.raises(OSError):
            sinks.publish({"a": df.limit(0)}, root)
    assert sinks.read_published(spark, root, "a").count() == 1 and sinks.read_published(spark, root, "b").count() == 1
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda k: sinks.publish({f"t{k}": df}, root, keep=9), range(3)))
    assert sorted(versions) == [2, 3, 4] and set(sinks.published(spark, root)) == {"a", "b", "t0", "t1", "t2"}
