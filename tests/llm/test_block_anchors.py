"""Repeated passages of words against a plain version; words and pieces of long texts; edges."""

import hashlib
import random
import re

import numpy as np
import pytest

from siltstone.llm import block_anchors as ba
from siltstone.llm.block_anchors import SLICE, WINDOW, remove_passages, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """rows (doc_id, text) in the order in which passages count: (n_words, n_removed, kept) of each."""
    seen, out = set(), []
    for _, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - WINDOW + 1):
            window = tuple(words[i : i + WINDOW])
            if window in seen:
                gone.update(range(i, i + WINDOW))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got(df, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_passages(df, **more).collect()}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["straße", "日本", "x" * 200]
    passages = [" ".join(r.choice(vocabulary) for _ in range(k)) for k in (12, 19, 20, 21, 25, 33, 60)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))))
        sep = r.choice([" ", "\n", "\t ", "\r\n"])
        rows.append((i, sep.join(p.replace(" ", sep) if r.random() < 0.3 else p for p in parts)))
    for i in range(n, n + 20):  # copies and near copies
        words = WORD.findall(rows[r.randrange(n)][1])
        for _ in range(r.randint(0, 2)):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(["lead"] * r.randint(0, 11) + words)))
    return rows


@pytest.mark.parametrize("seed,unit", [(1, 2000), (2, 16 << 20), (3, 300)])
def test_equals_plain_version(spark, seed, unit):
    rows = corpus(seed)
    order = list(range(len(rows)))
    random.Random(seed).shuffle(order)
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert got(df, unit_bytes=unit) == {i: want[i] for i, _ in rows}


def test_edges(spark):
    line = " ".join(f"v{i}" for i in range(24))
    rows = [(None, line, "a"), (3, line, "b"), (1, None, "c"), (2, "", "d"), (4, " \n", "e"), (5, " ".join(f"v{i}" for i in range(19)), "f"), (6, "z " * 50, "g"), (7, line + " end", "h"), (7, line + " end", "i"), (8, line.replace(" ", "\t\n"), "j")]
    df = spark.createDataFrame([(a, b, c, 1, 2, "x", "y", 3) for a, b, c in rows], "doc_id long, text string, row string, block int, id int, body string, words string, start int")
    out = remove_passages(df, carry=("row", "block"), with_text=True).collect()
    by = {r.carried.row: r for r in out}
    assert len(out) == len(rows) and all(r.carried.block == 1 for r in out)
    told = {k: (r.n_words, r.n_removed, r.kept_text) for k, r in by.items()}
    assert told["a"] == (24, 0, line) and told["b"] == (24, 24, "") and told["j"] == (24, 24, "")  # the null doc_id comes first
    assert told["c"] == told["d"] == told["e"] == (0, 0, "") and told["f"][1] == 0  # 19 words are no window
    assert told["g"] == (50, 49, "z")  # its second window covers all but the first word
    assert {told["h"], told["i"]} == {(25, 25, ""), (25, 24, "end")} or told["h"] != told["i"]
    assert sorted(told[k][1] for k in "hi") == [24, 25]  # equal rows of one doc_id: one of them counts as the earlier
    assert remove_passages(df.limit(0)).collect() == [] and remove_passages(df.limit(0)).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    text_ids = spark.createDataFrame([("x", line), ("y", line)], "doc_id string, text string")
    assert sorted(r.n_removed for r in remove_passages(text_ids).collect()) == [0, 24]


def test_words_of_long_texts_do_not_depend_on_pieces():
    r = random.Random(5)
    texts = [b"", b" \t", " ".join(r.choice(["x", "yy", "zebra", "ß"]) for _ in range(600_000)).encode(), b"q" * (3 * SLICE), b"a " * 10 + b"w" * (5 * SLICE // 2) + b" tail end", b"k" * SLICE + b" " + b"m" * (3 * SLICE) + b"\nx y"]
    hashes, bounds = words_of(texts)
    split = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(bounds).tolist() == [len(x) for x in split]
    told = {}
    for h, w in zip(hashes.tolist(), (w for x in split for w in x)):
        assert told.setdefault(w, h) == h
    assert len(set(told.values())) == len(told)
    for text, words in zip(texts, split):
        n = len(words)
        cut = np.array([[0, 3, 10], [0, 8, 33], [0, n - 5, n]]) if n > 60 else np.zeros((0, 3), np.int64)
        stay = words[:3] + words[33:-5] if n > 60 else words
        assert ba._kept(text, cut) == (n, n - len(stay), b" ".join(stay))


def test_a_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "a " * 2_000_000), (2, "b" * 3_000_000), (3, "a " * 30)], "doc_id long, text string")
    one = hashlib.sha256(b"a").hexdigest()
    assert got(df) == {1: (2_000_000, 1_999_999, one), 2: (1, 0, hashlib.sha256(b"b" * 3_000_000).hexdigest()), 3: (30, 30, hashlib.sha256(b"").hexdigest())}


def test_keys_of_one_half_are_told_apart():
    key, other = np.array([5, 5, 5, 2, 5], np.uint64), np.array([1, 2, 1, 9, 2], np.uint64)
    first, late = ba.earliest(key, other)
    assert sorted(first.tolist()) == [0, 1, 3] and late.tolist() == [False, False, True, False, True]


def test_packed_columns_come_back():
    r = np.random.default_rng(1)
    a, b = np.sort(r.integers(0, 1 << 63, 1000, dtype=np.uint64)), r.integers(0, 9, 1000)
    x, y = ba.unpacked(ba.packed(a, b))
    assert (x == a).all() and (y == b).all() and len(ba.unpacked(ba.packed(a[:0], b[:0]))[0]) == 0
