"""Suffix-array dedup against a brute-force version."""

import hashlib
import random

import pytest

from siltstone.llm.common import numbered
from siltstone.llm.suffix_dedup import front_code, front_decode, merge_runs, passes, remove_repeats


def brute(rows, match):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - match + 1):
            w = b[p : p + match]
            if w in seen:
                for q in range(p, p + match):
                    gone[q] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def made(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(30) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and rows:
            t = r.choice(rows)[1]
        elif kind < 0.4 and rows and (t := r.choice(rows)[1]):
            k = r.randrange(len(t) + 1)
            t = t[:k] + "X" + t[k + 1 :]
        elif kind < 0.6:
            t = text(10) + r.choice(passages) + text(10)
        elif kind < 0.65:
            t = "a" * r.randint(0, 300)
        elif kind < 0.7:
            t = (text(4) + "\n") * r.randint(1, 20)
        else:
            t = text(r.randint(0, 60))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("match,gram,hot", [(100, 32, 20_000), (24, 8, 20_000), (24, 8, 3), (100, 32, 5)])
def test_equals_brute_force(spark, match, gram, hot):
    rows = made(match + hot)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(x) for x in remove_repeats(df, match, gram, hot).collect()), key=str)
    assert got == brute(sorted(rows), match)


def test_edges(spark):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(30_000))
    rows = [(None, long), (1, long[50:]), (2, None), (3, ""), (3, long[:200]), (4, long[:200]), (5, "short")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, block long, body string")
    got = sorted((tuple(x) for x in remove_repeats(df).collect()), key=str)
    assert got == brute(rows, 100)
    assert remove_repeats(df.limit(0)).count() == 0


def test_carried_columns_and_text(spark):
    df = spark.createDataFrame([(1, "é" * 60, "fr"), (2, "é" * 60 + "z", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in remove_repeats(df, carry=("lang",), with_text=True).collect()}
    assert got[2].kept_text == "z" and got[2].lang == "fr" and got[2].n_removed == 120


def test_merge_and_front_coding():
    r = random.Random(5)
    every = [[bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 40))] for _ in range(7)]
    runs = []
    for x in every:
        x.sort()
        lcps, tails = front_code(x)
        assert front_decode(lcps.tolist(), [len(s) for s in x], tails) == x
        runs.append((x, lcps.tolist()))
    out, before = [], b""
    for s, i, shared in merge_runs(runs):
        now = runs[s][0][i]
        assert now[:shared] == before[:shared] and (now == before or now[shared : shared + 1] != before[shared : shared + 1])
        out.append(now)
        before = now
    assert out == sorted(x for run in every for x in run)


@pytest.mark.parametrize("match,gram,hot,fan", [(24, 8, 20_000, 2), (24, 8, 3, 3), (100, 32, 5, 2)])
def test_several_merges_equal_brute_force(spark, monkeypatch, match, gram, hot, fan):
    rows = made(match + hot + fan)
    monkeypatch.setattr("siltstone.llm.suffix_dedup.numbered", lambda df, body: numbered(df, body, 500))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(x) for x in remove_repeats(df, match, gram, hot, fan).collect()), key=str)
    assert got == brute(sorted(rows), match)


def test_merges_meet_a_bounded_number_of_runs():
    for blocks, fan in ((1, 4), (4, 4), (5, 4), (1000, 4), (12_000_000, 4096)):
        plan = passes(blocks, 1 << 10, fan)
        assert plan[-1] == (1 << 10, 1) and [r for r, _ in plan] == sorted(r for r, _ in plan)
        runs = [blocks, *(g for _, g in plan[:-1])]
        assert all(-(-a // g) <= fan for a, (_, g) in zip(runs, plan)) and len(plan) <= 6


def test_blocks_are_bounded_by_bytes_and_rows(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, body string").coalesce(1)
    got = numbered(df, "body", 200).selectExpr("row >> 10 as block", "length(body) as n", "row").collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.block, []).append(r.n)
    assert all(sum(x) <= 200 for x in sizes.values()) and [r.row for r in got] == sorted({r.row for r in got})
    assert max(len(x) for x in sizes.values()) <= 1024 and len(numbered(df.limit(0), "body").collect()) == 0
    assert numbered(spark.createDataFrame([("y" * 999,)] * 2, "body string"), "body", 10).selectExpr("row >> 10").distinct().count() == 2


def test_ties_do_not_depend_on_the_scan(spark):
    base = "".join(random.Random(9).choice("abcdefgh ") for _ in range(300))
    rows = [(1, base + "p"), (1, base + "q"), (1, "r" + base), (None, base)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        seen.add(str(sorted((tuple(x) for x in remove_repeats(df).collect()), key=str)))
    assert len(seen) == 1


def test_a_task_writes_few_buckets(spark):
    import numpy as np
    from itertools import islice

    from siltstone.llm.common import block_numbers, bucket_of
    from siltstone.sources import workspace

    x = [0, 1, -5, 7 << 32, (3 << 32) + 12345]
    told = [r.b for r in spark.createDataFrame([(v,) for v in x], "x long").selectExpr("pmod(hash(x), 37) as b").collect()]
    assert bucket_of(np.array(x, np.int64), 37).tolist() == told
    for part, buckets, each in ((0, 8, 1), (5, 8, 2), (7, 1000, 3)):
        got = list(islice(block_numbers(part, buckets, each), 12))
        assert got == sorted(set(got)) and all(b >> 32 == part for b in got)
        assert set(bucket_of(np.array(got), buckets).tolist()) == {(part * each + k) % buckets for k in range(each)}
    df = spark.createDataFrame([(i, "some text " * 30) for i in range(200)], "doc_id long, text string")
    assert remove_repeats(df).count() == 200 and workspace.clean(spark) > 0


@pytest.mark.parametrize("hot", [20_000, 40])
def test_long_runs_and_periods(spark, hot):
    """Runs of one character and short periods over several slices, beside others; hot anchors' windows fall together."""
    rows = [(1, "a" * 1_500_000), (2, "ab" * 700_000), (3, "b" + "a" * 3000), (4, " " * 1_300_000 + "tail"), (5, "ba" * 900 + "c" * 99), (6, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    # all but the first window's first byte goes; of a period of two, the first two windows stay whole
    want = {1: (1_500_000, 1_499_999, 1), 2: (1_400_000, 1_399_998, 1), 3: (3001, 3000, 1), 4: (1_300_004, 1_299_999, 1), 5: (1899, 1800, 1), 6: (0, 0, 0)}
    assert got == want


def test_repeated_windows_of_a_chunk():
    import numpy as np

    from siltstone.llm.suffix_dedup import repeated_here

    r = random.Random(2)
    text = "".join(r.choice(["aaaa", "ab", "c"]) for _ in range(600)).encode()
    starts = list(range(len(text) - 40 + 1))
    r.shuffle(starts)
    seen, want = set(), []
    for s in starts:
        want.append(text[s : s + 40] in seen)
        seen.add(text[s : s + 40])
    assert repeated_here(np.frombuffer(text, np.uint8), np.array(starts), 40, 16).tolist() == want
