"""The Jaccard join against all pairs."""

import random
import re

import pytest

from siltstone.llm import jaccard_join
from siltstone.llm.components import components
from siltstone.llm.jaccard_join import Tile, jaccard_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def made(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["été", "Über"]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, hot = text(40), text(60)
    docs = []
    for i in range(n):
        k = r.random()
        if k < 0.25 and docs:
            t = list(r.choice(docs))
        elif k < 0.5:
            t = list(hot)
        elif k < 0.7 and docs:
            t = list(r.choice(docs))
        elif k < 0.8:
            t = text(r.randint(0, 30)) + passage + text(r.randint(0, 30))
        else:
            t = text(r.choice([0, 1, 3, 5, 6, 8, 20, 80, 200]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3]) if t else 0):
            t[r.randrange(len(t))] = r.choice(vocab)
        if r.random() < 0.2:
            t = t[: r.randint(0, len(t))]
        docs.append(t)
    return [(i, r.choice([" ", "  ", "\n"]).join(t) if t or r.random() < 0.5 else None) for i, t in enumerate(docs)]


@pytest.mark.parametrize("tile,n,seed", [(256, 300, 1), (8, 300, 2), (3, 200, 3), (16, 500, 4)])
def test_equals_all_pairs(spark, monkeypatch, tile, n, seed):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = made(seed, n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    groups = {}
    for r in got:
        if r.n_shingles:
            groups.setdefault(r.component_id, []).append(r.kept)
    assert all(sum(k) == 1 for k in groups.values())


def test_edges(spark):
    rows = [(1, "A b C"), (2, "a B c"), (2, "a b"), (None, "a b c"), (None, None), (3, " \t"), (4, "x " * 3000), (5, "X " * 3001), (6, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == brute(rows)
    assert jaccard_components(df.limit(0)).count() == 0


def test_long_words_of_one_polynomial_differ(spark):
    """Thue-Morse words and their complements have equal polynomials modulo 2 ** 64 for every odd base."""
    parity = [bin(i).count("1") & 1 for i in range(4096)]
    words = ["".join(letters[p] for p in parity[:n]) for n in (1024, 2048, 4096) for letters in ("ab", "ba", "AB", "01")]
    rows = [(i, f"one {w} two") for i, w in enumerate(words)] + [(100 + i, f"one {w} two x y z {w}") for i, w in enumerate(words)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.root for r in components(df).collect()} == {0}


def test_bitmaps_never_lose_a_link():
    import numpy as np

    r = random.Random(9)
    pool = [r.getrandbits(64) for _ in range(60)]
    sets = [sorted(r.sample(pool, r.randint(3, 50))) for _ in range(60)]
    t = Tile(list(range(60)), [len(s) for s in sets], [np.array(s, np.uint64).tobytes() for s in sets], list(range(60)))
    list(t.links())
    root = {i: i for i in range(60)}
    for i in range(60):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = root[i], root[j]
                root = {k: y if v == x else v for k, v in root.items()}
    mine = dict(zip(t.rows, t.part))
    assert all((mine[i] == mine[j]) == (root[i] == root[j]) for i in range(60) for j in range(60))
