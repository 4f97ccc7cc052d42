"""Mixtures per source against one that is computed in NumPy; trees of sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import mixture, tree


def plain(ids, x, components, turns, tolerance, hashes):
    """Expectation and maximisation over whole arrays, with centred covariances: clusters and mean log-likelihood."""
    n, d = x.shape
    k = min(components, n // 2)
    seeds = x[sorted(range(n), key=lambda i: (hashes[ids[i]], ids[i]))[:k]]
    near = (((x[:, None] - seeds[None]) ** 2).sum(2) - (x * x).sum(1)[:, None]).round(9).argmin(1)
    r, before = np.eye(k)[near], None
    model = None
    for turn in range(turns + 1):
        if turn:
            w, mu, cov = model
            logs = np.empty((n, k))
            for c in range(k):
                sign, logdet = np.linalg.slogdet(cov[c])
                diff = x - mu[c]
                logs[:, c] = np.log(w[c]) - 0.5 * (d * np.log(2 * np.pi) + logdet + (diff * np.linalg.solve(cov[c], diff.T).T).sum(1))
            top = logs.max(1, keepdims=True)
            ll = top[:, 0] + np.log(np.exp(logs - top).sum(1))
            r = np.exp(logs - ll[:, None])
            if turn == turns or before is not None and abs(ll.mean() - before) < tolerance:
                return dict(zip(ids, r.argmax(1).tolist())), ll.mean()
            before = ll.mean()
        nk = r.sum(0) + 10 * np.finfo(float).eps
        mu = (r.T @ x) / nk[:, None]
        cov = [((x - mu[c]) * r[:, c : c + 1]).T @ (x - mu[c]) / nk[c] + 1e-6 * np.eye(d) for c in range(k)]
        model = (r.sum(0) / n, mu, cov)


def rows(seed=3):
    r = np.random.default_rng(seed)
    out = []
    for source, n, centres in (("a", 300, 4), ("b", 60, 3), (None, 40, 2), ("c", 3, 1), ("d", 5, 1)):
        c = r.normal(size=(centres, 3)) * 4
        out += [(f"{source}{i}", (c[i % centres] + r.normal(size=3)).tolist(), source) for i in range(n)]
    return out


@pytest.mark.parametrize("chunk,turns", [(2048, 30), (20, 30), (7, 3)])
def test_clusters_and_likelihoods_equal_numpy(spark, chunk, turns):
    data = rows()
    df = spark.createDataFrame(data, "id string, embedding array<double>, source_doc_id string")
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    got = {r.id: (r.cluster, r.log_likelihood) for r in mixture.cluster(df, 4, turns, 1e-6, chunk=chunk).collect()}
    assert len(got) == len(data)
    for source in ("a", "b", None, "d"):
        own = [r for r in data if r[2] == source]
        ids = [r[0] for r in own]
        want, ll = plain(ids, np.array([r[1] for r in own]), 4, turns, 1e-6, hashes)
        assert {i: got[i][0] for i in ids} == want
        assert all(got[i][1] == pytest.approx(ll, abs=1e-6) for i in ids)
    assert {got[r[0]] for r in data if r[2] == "c"} == {(0, None)}  # too few to be clustered


def test_edges(spark):
    data = [(1, [0.0, 1.0], "s"), (2, [0.1, 1.0], "s"), (3, [5.0, 1.0], "s"), (4, [5.1, 1.0], "s"), (5, None, "s"), (6, [1.0], "s"), (7, [None, 1.0], "s"), (8, [0.0, 1.0], "s")]
    df = spark.createDataFrame(data, "id long, embedding array<double>, source_doc_id string").withColumn("x", F.lit(1)).withColumn("chunk", F.lit("y")).withColumn("component", F.lit("z"))
    got = {r.id: r.cluster for r in mixture.cluster(df, 2, 10).collect()}
    assert len(got) == 8 and got[1] == got[8] and set(got.values()) <= {0, 1} and got[5] == got[6] == got[7] == 0
    assert mixture.cluster(df.limit(0)).collect() == []


def test_each_source_has_its_own_tree(spark):
    data = [(i, e, s) for i, e, s in rows() if s in ("a", "b", "c")]
    df = spark.createDataFrame(data, "id string, embedding array<double>, source_doc_id string")
    vectors = {i: e for i, e, _ in data}
    leaves = df.select("id", F.col("id").alias("text"), "source_doc_id")
    known = df.select(F.col("id").alias("text"), "embedding")

    def embed(nodes):  # a summary lies at its first text's place
        return nodes.withColumn("_t", F.split_part("text", F.lit(" "), F.lit(1))).join(known.withColumnRenamed("text", "_t"), "_t").drop("_t")

    t = tree.build(leaves, embed, lambda texts: F.array_join(texts, " "))
    nodes = t.collect()
    assert not tree.issues(t).count()
    by = {n.id: n for n in nodes}
    for n in nodes:
        if n.child_ids:
            assert {by[c].source_doc_id for c in n.child_ids} == {n.source_doc_id} and len({by[c].level for c in n.child_ids}) == 1
    tops = {s: max(n.level for n in nodes if n.source_doc_id == s) for s in "abc"}
    assert tops["a"] >= 2 and tops["b"] >= 2 and tops["c"] == 0  # three nodes are too few for a summary
    assert len(vectors) == sum(n.level == 0 for n in nodes)
