"""Evidence text, validators, REST source, judges."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation, validation
from siltstone.plans import evidence
from siltstone.sources import rest


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("row,text", [
    ({"company": "Apple", "subsidiary": "One Ltd", "year": 2024, "source_form_type": "10-K"}, "Apple subsidiary in 2024: One Ltd | Source form: 10-K"),
    ({"company": "Apple", "board_member": "Ann Lee", "title": "Chair"}, "Apple board member: Ann Lee | Title: Chair"),
    ({"company": "Apple", "patent_id": "US1", "patent_title": "Lens", "grant_date": "2024-01-01"}, "Apple patent: US1 | Title: Lens | Grant date: 2024-01-01"),
    ({"ticker": "AAPL", "filing_id": "AAPL_10-K_2024", "form_type": "10-K", "year": 2024}, "AAPL filing: 2024 10-K | Filing ID: AAPL_10-K_2024"),
    ({"company": "Apple", "section_id": "s1", "text": "Body", "section_title": "Risk", "year": 2024, "form_type": "10-K"}, "Apple 2024 10-K section: Risk | Section ID: s1\nBody"),
    ({"company": "Apple", "cpc_prefix": "H04", "label": "Telecom"}, "Apple technology domain: H04 | Telecom"),
    ({"a": 1, "b": "x"}, "a: 1\nb: x"),
])
def test_row_text(spark, row, text):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    assert one(df, evidence.row_text(df)) == text


def test_contexts(spark):
    df = spark.createDataFrame([(1, " body ", None, "src")], "n int, content string, title string, source string")
    assert one(df, evidence.context_block(F.col("n"), F.col("content"), F.col("title"), F.lit(None), F.col("source"))) == "[Document 1]\nTitle: src\nPage: None\nSource: src\n\nContent:\nbody\n"
    assert one(df, evidence.short_context(F.col("n"), F.col("content"), F.lit("T"), F.lit(3))) == "[Document 1] T (page 3)\nbody"
    assert one(df, evidence.web_context(F.col("n"), F.col("content"), F.lit("T"), F.lit("u"))) == "[Web Result 1] T\nURL: u\nbody"
    r = spark.createDataFrame([(None, "sql", ["[Document 1] A\nx", "[Document 2] A\nx", "[Document 3] B\ny"])], "plan_type string, final_route string, contexts array<string>")
    got = evidence.finalized(r, True, False).first()
    assert (got.plan_type, got.tier, got.retrieved_context_count) == ("single", "tier_1", 2)


@pytest.mark.parametrize("bad,good", [("I nsider Trading Policy", "Insider Trading Policy"), ("Reco very Pol icy", "Recovery Policy"), ("Trading Policy", "Trading Policy"), ("", ""), ("Pol icy", "Policy")])
def test_repaired_heading(spark, bad, good):
    assert one(spark.range(1), evidence.repaired_heading(F.lit(bad))) == good


def test_table_text_and_parsing(spark):
    rows = F.array(F.array(F.struct(F.lit("Year").alias("name"), F.lit("2024").alias("value")), F.struct(F.lit("x").alias("name"), F.lit(" ").alias("value"))))
    assert one(spark.range(1), evidence.table_text(F.lit(1), F.lit(""), F.array(F.lit("Year"), F.lit("x")), F.lit(2), F.lit(2), rows)) == "Structured Financial Table 1\nHeaders: Year, x\nDimensions: rows=2, cols=2\nRows:\nYear: 2024"
    assert one(spark.range(1), evidence.parsed_score(F.lit('```json\n{"contradiction_score": 7, "severity": "high"}\n```')))["contradiction_score"] == 7
    assert one(spark.range(1), evidence.parsed_score(F.lit("no json")))["severity"] == "low"
    df = spark.createDataFrame([("a\tb\n", None)], "x string, y string")
    assert one(df, evidence.escaped_tsv(["x", "y"])) == "a\\tb\\n\t\\N"
    d = spark.createDataFrame([([("dim", "mem")],), ([],)], "s array<struct<dimension:string,value:string>>")
    dim, member = evidence.first_segment(F.col("s"), {"mem": "Member"})
    assert [tuple(r) for r in d.select(dim, member).collect()] == [("dim", "Member"), (None, None)]


def test_validators(spark, tmp_path):
    t = spark.createDataFrame([("a", "Risk Factors here"), ("a", "x"), ("b", "nothing"), ("", "y")], "source string, text string")
    assert tuple(validation.coverage(t).first()) == (4, 2)
    assert {(r.source, r.section) for r in validation.missing_sections(t.where("source <> ''"), ["risk factors", "MD&A"]).collect()} == {("a", "MD&A"), ("b", "risk factors"), ("b", "MD&A")}
    f = spark.createDataFrame([("a", "us-gaap:Assets", None, "c"), ("a", "us-gaap:Revenue", None, None)], "source string, tag string, name string, context string")
    assert [r.tag for r in validation.missing_tags(f).collect()] == ["us-gaap:NetIncomeLoss"] and validation.without_context(f).count() == 1
    assert validation.run_path(str(tmp_path), "run_1").endswith("run_1.json")
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            validation.run_path(str(tmp_path), bad)
    with pytest.raises(FileNotFoundError):
        validation.members_exist(str(tmp_path), ["sub.txt"])


def test_rest_source(spark, tmp_path):
    def fetch(query, cursor):
        n = int(cursor or 0)
        return [(query, n), (query, n + 1)], str(n + 2) if n < 6 else None

    rest.register(spark, rest.rest_source("cases", "q string, n int", fetch, ["a", "b"], limit=5, spacing=0))
    got = spark.read.format("cases").load()
    assert sorted(map(tuple, got.collect())) == [(q, n) for q in "ab" for n in range(5)]
    (tmp_path / "c.yaml").write_text("A: 450 # words\nB: 'x'\n")
    assert rest.settings(str(tmp_path / "c.yaml")) == {"A": "450", "B": "x"} and rest.settings("/no/such") == {}


def test_judges(spark):
    items = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, "x", "y")], "id int, answer string, expected string")
    got = evaluation.judged(items, lambda pairs: [{"completeness": 0.5, "contradiction_rate": 2} if a == "a" else {} for a, _ in pairs])
    assert {(r.id, r.metric): r.value for r in got.collect()} == {(1, "completeness"): 0.5, (1, "contradiction_rate"): 1.0, (2, "completeness"): 1.0, (2, "contradiction_rate"): 1.0, (3, "completeness"): 0.0, (3, "contradiction_rate"): 0.0}


def test_nested_settings(tmp_path):
    (tmp_path / "n.yaml").write_text("top: 1\nchunking:\n  size: 450  # words\n  overlap: 80\nmodels:\n  embed:\n    name: 'x: y'\n  list:\n    - a\n    - b\nlast: z\nitems:\n- p\n- q\nempty:\n")
    assert rest.settings(str(tmp_path / "n.yaml")) == {"top": "1", "chunking": {"size": "450", "overlap": "80"}, "models": {"embed": {"name": "x: y"}, "list": ["a", "b"]}, "last": "z", "items": ["p", "q"], "empty": None}


def test_archive_is_fetched_again_and_checked(tmp_path):
    import io
    import zipfile

    def zipped(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)
        return out.getvalue()

    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("busy")
        return zipped(**{"sub.txt": "a", "num.txt": "b"})

    got = rest.fetch_archive("u", str(tmp_path / "z"), fetch, ("sub.txt", "num.txt"), sleep=waits.append)
    assert len(got) == 2 and waits == [1.0, 2.0] and (tmp_path / "z" / "sub.txt").read_text() == "a"
    with pytest.raises(FileNotFoundError):
        rest.fetch_archive("u", str(tmp_path / "y"), lambda u: zipped(a="x"), ("sub.txt",))
    with pytest.raises(ValueError):
        rest.fetch_archive("u", str(tmp_path / "y"), lambda u: zipped(**{"../out": "x"}))
    with pytest.raises(OSError):
        rest.fetch_archive("u", str(tmp_path / "y"), lambda u: (_ for _ in ()).throw(OSError()), sleep=lambda s: None)
