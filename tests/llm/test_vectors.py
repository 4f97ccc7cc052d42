"""Vector codes and centroids against plain versions, the pruning's exactness, held-out error, edges."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException

from siltstone.llm import sort_means, vector_codes
from siltstone.llm.lattice import on_lattice


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in sorted(rows, key=lambda r: r[0])]
    w = len(rows[0][2]) // parts
    books = [[r[2][m * w : (m + 1) * w] for r in rows[:entries]] for m in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for m in range(parts):
            got = [[] for _ in books[m]]
            for r in rows:
                x = r[2][m * w : (m + 1) * w]
                got[near(x, books[m])[1]].append(x)
            books[m] = [[sum(c) // len(g) for c in zip(*g)] if g else b for g, b in zip(got, books[m])]
    out, by_label = {}, {}
    for i, label, v in rows:
        told = [near(v[m * w : (m + 1) * w], books[m]) for m in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in told), sum(d for d, _ in told))
        by_label[label] = by_label.get(label, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (*out[i], by_label[label], digest) for i, label, _ in rows}


def made(n, dims, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.choice([-1, 1]) * r.random() * spread for _ in range(dims)], r.choice([None, 1, 2, 3])) for i in range(n)]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, v int, error string")


@pytest.mark.parametrize("n,dims,kind", [(90, 16, "double"), (40, 64, "double"), (5, 8, "double")])
def test_codes_equal_plain_version(spark, n, dims, kind):
    rows = made(n, dims, n)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.coded(frame(spark, rows, kind)).collect()}
    assert got == plain_codes(rows)


def test_annulus_gives_the_nearest_entry_and_skips_some():
    r = np.random.default_rng(3)
    for trial in range(60):
        k, w = int(r.integers(1, 17)), int(r.integers(1, 9))
        book = r.integers(-40, 40, (k, w)) * int(r.choice([1, 1000, 1 << 18]))
        x = np.concatenate((r.integers(-60, 60, (200, w)) * int(r.choice([1, 1000])), book, np.zeros((1, w), np.int64)))
        which, best = vector_codes.nearest(x, book)
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (which == d.argmin(1)).all()
    seen = []
    scales = np.arange(1, 17)[:, None] * 100
    vector_codes.nearest(np.repeat(scales, 50, 0) * np.ones((1, 8), np.int64), scales * np.ones((1, 8), np.int64), seen)
    assert sum(seen) < 0.3 * 800 * 16  # norms far apart: the annulus holds few entries


def test_code_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5] * 8, None), (None, [0.25] * 8, None), (1, [0.5] * 8, 4), (1, [0.75] * 8, 4), (2, None, 1), (4, [None] + [0.1] * 7, 1), (5, [nan] + [0.1] * 7, 1), (6, [inf] + [0.1] * 7, 1), (7, [0.1] * 7, 1), (8, [], 1), (9, [0.1] * 16, 1)]
    out = vector_codes.coded(frame(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in out) == [(False, 1, "00" * 8, 0, 0), (False, 1, "01" * 8, 0, 0), (False, 3, "00" * 8, 0, 0), (True, 0, "03" * 8, 0, 0)]
    assert vector_codes.coded(frame(spark, rows).limit(0)).collect() == [] == vector_codes.coded(frame(spark, rows[4:8])).collect()
    with pytest.raises((SparkRuntimeException, PythonException), match="reaches"):
        vector_codes.coded(frame(spark, [(1, [1e9] * 8, 1)])).collect()


def test_codes_stand_for_vectors_near_by(spark):
    rows = made(300, 16, 9)
    vectors, books = vector_codes.trained(on_lattice(frame(spark, rows), 4096, keep=("vec_id", "label")))
    codes = vector_codes.encode(vectors, books)
    back = {r.vec_id: r.vector for r in vector_codes.decode(codes, books).collect()}
    error = np.mean([np.sum((np.array(v) - back[i]) ** 2) for i, v, _ in rows])
    assert error < 0.6 * np.mean([np.sum((np.array(v) - np.mean([x for _, x, _ in rows], axis=0)) ** 2) for _, v, _ in rows])


def plain_clusters(rows, dims, k, rounds, scale=256):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows]
    c = [v for _, v in sorted(rows, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        got = [[] for _ in c]
        for _, v in rows:
            got[near(v)[1]].append(v)
        c = [[sum(x) // len(g) for x in zip(*g)] if g else y for g, y in zip(got, c)]
    told = {i: near(v) for i, v in rows}
    per = {}
    for d, j in told.values():
        per[j] = per.get(j, 0) + d
    return {i: (j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in told.items()}


@pytest.mark.parametrize("n,spread", [(150, 1.0), (300, 0.02), (20, 1.0)])
def test_clusters_equal_plain_version(spark, n, spread):
    rows = made(n, 64, n, spread)
    got = {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in sort_means.clustered(frame(spark, rows, "double")).collect()}
    assert got == plain_clusters(rows, 64, 40, 5)


def test_scans_stop_early_and_are_exact():
    r = np.random.default_rng(4)
    for trial in range(40):
        k, w = int(r.integers(1, 30)), int(r.integers(1, 6))
        c = r.integers(-30, 30, (k, w))
        x = np.concatenate((r.integers(-40, 40, (300, w)), c, (c[:1] + c[-1:]) // 2))
        which, best = sort_means.nearest(x, r.integers(0, k, len(x)), c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (which == d.argmin(1)).all()
    seen = []
    c = r.integers(-1000, 1000, (40, 64))
    at = r.integers(0, 40, 2000)
    sort_means.nearest(c[at] + r.integers(-20, 20, (2000, 64)), at, c, seen)
    assert sum(seen) == 2000  # a vector near its centroid looks at no other


def test_cluster_edges(spark):
    nan = float("nan")
    same = [0.5] * 64
    rows = [(1, same, None), (1, same, None), (None, [0.25] * 64, None), (2, None, 1), (3, [None] + same[1:], 1), (4, [nan] + same[1:], 1), (5, same[1:], 1), (6, same + [0.5], 1), (7, [], 1)]
    out = sort_means.clustered(frame(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in out) == [(False, 0, 0, 0, 0), (False, 0, 0, 0, 0), (True, 2, 0, 0, 0)]
    assert sort_means.clustered(frame(spark, rows).limit(0)).collect() == [] == sort_means.clustered(frame(spark, rows[3:])).collect()
    with pytest.raises((SparkRuntimeException, PythonException), match="reaches"):
        sort_means.clustered(frame(spark, [(1, [1e9] * 64, 1)])).collect()
