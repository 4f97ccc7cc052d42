import math
import random
import re

from siltstone.llm import secret_scan as s


def names(spark):
    return spark.createDataFrame([(w,) for w in s.NAME_WORDS], "word string")


def test_held_out_accuracy(spark):
    words = names(spark)
    model = s.train(s.labelled_findings(spark), words)
    held = s.score(s.labelled_findings(spark, first=10_000_000, n=2000).withColumnRenamed("label", "y"), model, words)
    right = held.where("is_secret = (y = 1)").count()
    assert right / 2000 >= 0.97
    wrong = held.where("is_secret and y = 0").count()
    assert wrong / 1000 <= 0.03


def test_findings(spark):
    hex40 = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'prose token = "{hex40}" more', f"see commit {hex40} for it", "paid by 4123465659789240 on", None, "", "a " * 20000 + f'secret: "{hex40}"', f"x={hex40};y={hex40[::-1]}"]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, value string, nth int")
    got = {(r.doc_id, r.nth): r for r in s.scan(df).collect()}
    assert set(got) >= {(0, 0), (1, 0), (2, 0), (5, 0)} and not {3, 4} & {k for k, _ in got}
    assert got[0, 0].is_secret and got[5, 0].is_secret and got[5, 0].word_at == 20001
    assert not got[1, 0].is_secret and not got[2, 0].is_secret
    assert s.scan(df.limit(0)).count() == 0
    assert s.candidates(df.union(df)).count() == 2 * s.candidates(df).count()


def test_unquoted_assignments_and_bare_tokens(spark):
    hex40 = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    secrets = [f"then api_key={hex40} more", "set password=hunter2hunter2 now", f"export DB_SECRET={hex40}", "thing ghp_aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0iL3oR6 over", f"then token {hex40} more"]
    others = [f"then commit={hex40} more", "see key file data_model_train_v12 there", f"access commit {hex40} for it", "the api_key=example_data_value_v12 here"]
    df = spark.createDataFrame(list(enumerate(secrets + others)), "doc_id long, text string")
    got = {r.doc_id: r for r in s.scan(df).collect()}
    assert [got[i].is_secret for i in range(len(got))] == [True] * len(secrets) + [False] * len(others)
    assert got[0].n_chars == 40 and got[1].n_chars == 14 and got[2].value_sha256 == got[0].value_sha256


def test_no_feature_tells_the_label_alone(spark):
    rows = s.with_features(s.labelled_findings(spark), names(spark))
    seen = {(r.label, r.said_secret, r.assigned) for r in rows.select("label", "said_secret", "assigned").distinct().collect()}
    assert seen == {(y, a, b) for y in (0.0, 1.0) for a in (0.0, 1.0) for b in (0.0, 1.0) if (y, a, b) != (1.0, 0.0, 1.0)}


KEY = r"A-Za-z0-9+/_=\-"


def brute_candidates(text):
    """(word_at, nth, value) by plain scanning."""
    out = []
    words = re.split(r"[\x20\x09-\x0D]+", text or "")
    for i, w in enumerate(words):
        nth = 0
        for m in re.finditer(f"[{KEY}]+", w):
            run = m[0]
            if len(run) >= 16 and re.search("[0-9]", run):
                value = run
                for k in range(len(run) - 1, -1, -1):  # behind the last = that leaves eight characters with a digit
                    rest = run[k + 1 :]
                    if run[k] == "=" and len(rest.rstrip("=")) >= 8 and "=" not in rest.rstrip("=") and re.search("[0-9]", rest):
                        value = rest
                        break
                out.append((i, nth, value))
                nth += 1
    return out


def test_candidates_equal_plain_scanning(spark):
    r = random.Random(5)
    parts = ["a", "1", "key=", "=", "==", "-", "_", "/", ".", ":", '"', " ", "\n", "deadbeef", "0123456789", "ABCdef", "é", "abcdefgh"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", " " * 50, "x1" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in s.candidates(df).collect():
        got.setdefault(x.doc_id, []).append((x.word_at, x.nth, x.value))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_candidates(t), (t, got.get(i), brute_candidates(t))


def test_features_equal_plain_counting(spark):
    words = {"data", "model", "final", "the"}
    rows = [("data_model_v12_final", 'x/y.json="data_model_v12_final"', "see", "the", "z"), ("dataModelX9" * 3, "dataModelX9" * 3, "", "key:", ""), ("F33E61083DB5DBDF4BD2", "F33E61083DB5DBDF4BD2", "commit", "sha", "of"), ("a/b/c/0000000000000", "a/b/c/0000000000000", "", "", "")]
    df = spark.createDataFrame(rows + rows[:1], "value string, word string, before2 string, before string, after string")
    got = s.with_features(df, spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        v, n = x.value, len(x.value)
        runs = re.sub(r"[^A-Za-z]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v)).lower().split()
        kinds = re.sub(r"[^lU9]+", ".", re.sub("[0-9]+", "9", re.sub("[A-Z]+", "U", re.sub("[a-z]+", "l", v))))
        assert math.isclose(x.dictionary, sum(len(w) for w in runs if w in words) / n) and math.isclose(x.distinct, len(set(v)) / n)
        assert math.isclose(x.digits, sum(c.isdigit() for c in v) / n) and math.isclose(x.slashes, v.count("/") / n) and x.length == n
        assert math.isclose(x.transitions, (len(kinds) - 1) / n) and x.hex == bool(re.fullmatch("[0-9a-fA-F]+", v))
        assert math.isclose(x.path, sum(c in "/\\" for c in x.word) / len(x.word) + bool(re.search(r"[A-Za-z0-9_-]\.[a-z]{2,4}\W*$", x.word)))


def test_the_dictionary_is_the_corpus_own(spark):
    df = spark.createDataFrame([(i, "Commonword, (rareword%s) ab 'quoted' k3y" % ("" if i else "x")) for i in range(4)] + [(9, None)], "doc_id long, text string")
    got = {r.word for r in s.dictionary(df).collect()}
    assert got == {"commonword", "quoted", "rareword"} | set(s.NAME_WORDS)
    assert {r.word for r in s.dictionary(df, 1).collect()} == {"commonword"} | set(s.NAME_WORDS)


def test_labelled_texts_by_hand(spark):
    """Lines written by hand, apart from the generator: secrets as files and logs hold them, and what only looks so."""
    hex32, hex40 = "9f86d081884c7d659a2feaa0c55ad015", "2fd4e1c67a2d28fced849ee1bb76e7391b93eb12"
    yes = [f"aws_secret_access_key = wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1", f'"password": "{hex32}"', f"Authorization: Bearer {hex40}", f"export API_KEY={hex40}", f"token: ghp_16C7e42F292c6912E7710c838347Ae178B4a", f"secret = '{hex32}'"]
    no = [f"commit {hex40} fixes it", f"sha256: {hex40}{hex40[:24]}", "see docs/guide/version/index/2024/05/page1", "order number 4000123412341234567", f"md5 checksum {hex32}", "id 550e8400-e29b-41d4-a716-446655440000", "the file data_model_train_v12_final is here"]
    df = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    best = {}
    for x in s.scan(df).collect():
        best[x.doc_id] = best.get(x.doc_id, False) or x.is_secret
    found = sum(best.get(i, False) for i in range(len(yes)))
    wrong = sum(best.get(len(yes) + i, False) for i in range(len(no)))
    assert set(best) >= set(range(len(yes))) and found >= 5 and wrong <= 1, (best, found, wrong)


def test_a_kept_forest_gives_the_same_findings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "token = '2fd4e1c67a2d28fced849ee1bb76e7391b93eb12'"), (2, "commit 9f86d081884c7d659a2feaa0c55ad015"), (3, None)], "doc_id long, text string")
    first = s.scan(docs, fitted=s.kept(docs, str(tmp_path / "kept"))).orderBy("doc_id").collect()
    monkeypatch.setattr(s, "train", None)  # no second training
    again = s.scan(docs, fitted=s.kept(docs, str(tmp_path / "kept"))).orderBy("doc_id").collect()
    assert again == first and [r.doc_id for r in first] == [1, 2] and first[0].is_secret
