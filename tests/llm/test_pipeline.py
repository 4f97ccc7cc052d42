"""The pipeline's stages against brute force, on a small fixture."""

import random

from corpus_pipeline import COLUMNS, STAGES, near_copies, packing, personal_data, quality_rules, repeated_passages, run
from siltstone.llm.common import scratch
from test_jaccard_join import brute as near_brute
from test_pii import KINDS
from test_pii import brute as pii_brute
from test_suffix_dedup import brute as repeat_brute


def fixture():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage = text(40)
    rows = []
    for i in range(60):
        t = text(r.randint(12, 120))
        if i % 6 == 1:
            t = rows[i - 1][1]
        if i % 6 == 2:
            t = rows[i - 2][1] + " " + word()
        if i % 10 == 3:
            t += " " + passage + " " + text(5)
        if i % 10 == 4:
            t += f" a{i}@b.org and +1 (555) 555-{1000 + i}"
        if i % 12 == 7:
            t = "### " * 30
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
    rows += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, "few words", "en", "s", 9)]
    return rows


def test_stages(spark):
    def kept(df):
        return sorted(map(tuple, df.collect()))

    docs = spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long")
    step = {}
    for (name, stage), what in zip(STAGES, "qjspz"):
        out = stage(spark, docs, "")
        path = scratch(spark, name)
        out.write.parquet(path)
        step[what] = spark.read.parquet(path)
        if what != "z":
            assert tuple(step[what].columns) == COLUMNS
        docs = step[what]
    rows = {r[0]: r for r in fixture()}
    good = kept(step["q"])
    assert [r[0] for r in good] == [i for i in range(60) if i % 12 != 7] and all(r == rows[r[0]] for r in good)
    one = kept(step["j"])
    assert [r[0] for r in one] == sorted({c for _, _, c in near_brute([r[:2] for r in good])})
    left = kept(step["s"])
    want = repeat_brute([r[:2] for r in one], 100)
    assert len(left) == len([w for w in want if w[1] > w[2]]) and {r[0]: len(r[1].encode()) for r in left} == {w[0]: w[1] - w[2] for w in want if w[1] > w[2]}
    assert sum(w[2] for w in want) > 0 and all(r[4] == len(r[1]) for r in left)
    clean = {r[0]: r for r in kept(step["p"])}
    assert clean.keys() == {r[0] for r in left}
    for d, t, *_ in left:
        for a, k, b in reversed(pii_brute(t)):
            t = t[:a] + f"<{KINDS[k]}>" + t[b:]
        assert clean[d][1] == t and clean[d][4] == len(t)
    pieces = step["z"].collect()
    assert {p.doc_id for p in pieces} == clean.keys()
    assert all(sum(p.length for p in pieces if p.doc_id == d) == next(p.doc_tokens for p in pieces if p.doc_id == d) for d in clean)


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = run(spark, str(tmp_path))
    want = packing(spark, personal_data(spark, repeated_passages(spark, near_copies(spark, quality_rules(spark, docs, ""), ""), ""), ""), "")
    total = lambda df: sorted((r.doc_id, r.t) for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "t").collect())
    assert total(got) == total(want)


def test_stages_take_nulls_repeats_and_other_columns(spark):
    """Every stage by itself, on rows that the stages before it would have dropped."""
    line = "the quick brown fox jumps over the lazy dog while seven old wizards boil water for tea and sing of rivers"
    rows = [(None, line + " null id", None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (3, line, "en", "s", 9), (3, line, "en", "s", 9), (4, " \n\t", "en", "s", 3), (5, "x" * 300_000, "en", "s", 300_000), (6, "call a.b@c.org " + line, "de", "t", 1)]
    wide = "doc_id long, text string, lang string, source string, n_chars long, row long, block int, id int, body string, part string, kept string, share int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "b", "p", "k", 4) for r in rows], wide)
    kept = {"quality_rules": 4, "ngram_jaccard_join": 5, "suffix_array_dedup": 6, "pii": 8, "packing": None}
    for name, stage in STAGES:
        out = stage(spark, docs.select(*COLUMNS) if name not in ("quality_rules", "ngram_jaccard_join") else docs, "")
        got = out.collect()
        if name != "packing":
            assert tuple(out.columns) == COLUMNS and len(got) == kept[name], (name, [r.doc_id for r in got])
        else:
            assert sum(r.length for r in got if r.start == 0 and r.length == r.doc_tokens == 1) == 2  # null and empty text
        assert stage(spark, docs.select(*COLUMNS).limit(0), "").count() == 0
