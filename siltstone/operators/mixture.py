"""Gaussian mixtures of many sources at once, by expectation and maximisation over one table.

Every source has a mixture of its own, with full covariances. Points lie in the shared folder, cut into chunks of a
source of about CHUNK points. A source of one chunk takes its turns where it lies. A larger one is many tasks' work: a turn
sends the models to the chunks; each chunk gives, per component, the sums of its memberships, of its points and of their
outer products, which are added up in a tree of groups, ``FAN`` at a time, to one row per component: the next model. Sources
whose mean log-likelihood changes by less than ``tolerance`` are done. Models start from the points that are nearest to
seeds, chosen by a hash of the id, so the result does not depend on how rows are dealt out, but for rounding in sums.

Edges: a null source is a source of its own; null vectors, and those of another length than the source's first, are in
cluster 0 and in no sum; a source of fewer than four points is one cluster; equal points share a cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import bucketed, settled
from . import relational

COMPONENTS, TURNS, TOLERANCE, RIDGE = 10, 100, 1e-3, 1e-6
CHUNK, FAN = 2048, 16
_FOUND = "source string, id string, cluster int, log_likelihood double"
_SUMS = "source string, component int, part long, n double, sx binary, sxx binary, ll double, points long"


def log_densities(x: np.ndarray, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Log densities of rows of x under a Gaussian; root: Cholesky factor of the precision matrix (upper)."""
    y = x @ root - mean @ root
    return np.log(np.diag(root)).sum() - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.einsum("ij,ij->i", y, y))


def memberships(x: np.ndarray, weights: np.ndarray, means: list[np.ndarray], roots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each component in each row, and the row's log-likelihood."""
    logs = np.stack([np.log(w) + log_densities(x, m, r) for w, m, r in zip(weights, means, roots)], axis=1)
    top = logs.max(axis=1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - ll[:, None]), ll


def sums(x: np.ndarray, share: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    return [(float(r.sum()), r @ x, (x * r[:, None]).T @ x) for r in share.T]


def maximised(n: float, sx: np.ndarray, sxx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and precision root of a component from its sums."""
    n += 10 * np.finfo(float).eps
    mean = sx / n
    cov = sxx / n - np.outer(mean, mean)
    cov[np.diag_indices_from(cov)] += RIDGE
    lower = np.linalg.cholesky(cov)
    return mean, np.linalg.solve(lower, np.eye(len(mean))).T


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _models(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    pdf = pdf.sort_values("component")
    means = [np.frombuffer(m, np.float64) for m in pdf["mean"]]
    return pdf["weight"].to_numpy(np.float64), means, [np.frombuffer(r, np.float64).reshape(len(m), len(m)) for m, r in zip(means, pdf["root"])]


def _rows(key: tuple, x: np.ndarray, share: np.ndarray, ll: float) -> pd.DataFrame:
    told = sums(x, share)
    return pd.DataFrame([(key[0], c, key[1], n, sx.tobytes(), sxx.tobytes(), ll if c == 0 else 0.0, len(x) if c == 0 else 0) for c, (n, sx, sxx) in enumerate(told)], columns=[c.split()[0] for c in _SUMS.split(", ")])


def _to_seeds(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """All of each point to its nearest seed (ties to the first)."""
    return np.eye(len(s))[((s * s).sum(1)[None] - 2 * x @ s.T).round(9).argmin(axis=1)]


def _first(key: tuple, points: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    if not len(points) or not len(seeds):
        return pd.DataFrame([], columns=[c.split()[0] for c in _SUMS.split(", ")])
    x = _matrix(points["x"])
    return _rows(key, x, _to_seeds(x, _matrix(seeds.sort_values("component")["x"])), 0.0)


def fitted(x: np.ndarray, seeds: np.ndarray, turns: int, tolerance: float) -> tuple[np.ndarray, float]:
    """All turns over the points of one chunk: each point's component, and the mean log-likelihood."""
    share, before = _to_seeds(x, seeds), None
    for turn in range(turns):
        told = sums(x, share)
        means, roots = zip(*(maximised(n, sx, sxx) for n, sx, sxx in told))
        share, ll = memberships(x, np.array([n for n, _, _ in told]) / len(x), list(means), list(roots))
        ll = float(ll.mean())
        if before is not None and abs(ll - before) < tolerance:
            break
        before = ll
    return share.argmax(axis=1).astype(np.int32), ll


def _turn(key: tuple, points: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    if not len(points) or not len(models):
        return pd.DataFrame([], columns=[c.split()[0] for c in _SUMS.split(", ")])
    x = _matrix(points["x"])
    share, ll = memberships(x, *_models(models))
    return _rows(key, x, share, float(ll.sum()))


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.iloc[:1].copy()
    for c in ("sx", "sxx"):
        out[c] = [np.sum([np.frombuffer(v, np.float64) for v in pdf.sort_values("chunk")[c]], axis=0).tobytes()]
    for c in ("n", "ll", "points"):
        out[c] = [pdf[c].sum()]
    return out


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return _total(pdf)[[c.split()[0] for c in _SUMS.split(", ")]]


def _maximised(pdf: pd.DataFrame) -> pd.DataFrame:
    t = _total(pdf).iloc[0]
    sx = np.frombuffer(t["sx"], np.float64)
    mean, root = maximised(t["n"], sx, np.frombuffer(t["sxx"], np.float64).reshape(len(sx), len(sx)))
    return pd.DataFrame([(t["source"], t["component"], t["n"], mean.tobytes(), np.ascontiguousarray(root).tobytes(), t["ll"], t["points"])], columns=["source", "component", "n", "mean", "root", "ll", "points"])


def _model(partial: DataFrame, chunks: int) -> DataFrame:
    """source, component, weight, mean, root, ll (mean log-likelihood before this model). A group holds one component."""
    while chunks > FAN:
        partial = partial.withColumnRenamed("part", "chunk").withColumn("part", F.floor(F.col("chunk") / FAN)).groupBy("source", "component", "part").applyInPandas(_added, _SUMS)
        chunks = -(-chunks // FAN)
    each = settled(partial.withColumnRenamed("part", "chunk").groupBy("source", "component").applyInPandas(_maximised, "source string, component int, n double, mean binary, root binary, ll double, points long"), "mixture")
    total = each.groupBy("source").agg((F.sum("ll") / F.sum("points")).alias("ll"), F.sum("points").alias("points"))
    return each.drop("ll", "points").join(total, "source").select("source", "component", (F.col("n") / F.col("points")).alias("weight"), "mean", "root", "ll")


def _turns(staged: DataFrame, components: int, turns: int, tolerance: float) -> DataFrame:
    """source, id, cluster, log_likelihood of sources of several chunks (source, chunk, h, id, x, points)."""
    parts = F.least(F.lit(components), F.floor(F.col("points") / 2))
    seeds = relational.top_per(staged, ["source"], [F.col("h"), F.col("id")], components, "seed").where(F.col("seed") <= parts)
    seeds = seeds.select("source", (F.col("seed") - 1).cast("int").alias("component"), "x")
    cells = settled(staged.groupBy("source", "chunk").agg(F.count("*").alias("n")), "mixture-chunks").drop("n")
    most = cells.agg(F.coalesce(F.max("chunk"), F.lit(0))).first()[0] + 1
    grouped = staged.select("source", "chunk", "x")

    def sent(models: DataFrame) -> DataFrame:
        return cells.join(models, "source").groupBy("source", "chunk")

    model = _model(grouped.groupBy("source", "chunk").cogroup(sent(settled(seeds, "seeds"))).applyInPandas(_first, _SUMS), most)
    done, before = None, None
    for turn in range(turns):
        new = _model(grouped.groupBy("source", "chunk").cogroup(sent(model)).applyInPandas(_turn, _SUMS), most)
        told = new.groupBy("source").agg(F.max("ll").alias("ll"))
        go = told if before is None else told.join(before.withColumnRenamed("ll", "was"), "source").where(F.abs(F.col("ll") - F.col("was")) >= tolerance).select("source", "ll")
        last = turn == turns - 1
        # a source that is done keeps the model that gave its last likelihood
        ended = model.drop("ll").join(told, "source")
        ended = settled(ended if last else ended.join(go, "source", "left_anti"), "mixture-done")
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        model, before = settled(new.join(go, "source", "left_semi"), "mixture"), settled(go, "likelihoods")
        if model.isEmpty():
            break

    def assign(key: tuple, points: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(models):
            return pd.DataFrame([], columns=["source", "id", "cluster", "log_likelihood"])
        share, _ = memberships(_matrix(points["x"]), *_models(models))
        return pd.DataFrame({"source": key[0], "id": points["id"], "cluster": share.argmax(axis=1).astype(np.int32), "log_likelihood": models["ll"].iloc[0]})

    return staged.select("source", "chunk", "id", "x").groupBy("source", "chunk").cogroup(sent(done)).applyInPandas(assign, _FOUND)


def cluster(nodes: DataFrame, components: int = COMPONENTS, turns: int = TURNS, tolerance: float = TOLERANCE, source: str = "source_doc_id", chunk: int = CHUNK) -> DataFrame:  # A18, T01
    """Adds ``cluster`` and ``log_likelihood`` (the source's mean, null where it is one cluster by size) to nodes (id,
    embedding, source): each source's mixture has ``components`` parts, or half as many as it has nodes if those are fewer."""
    key = F.to_json(F.struct(source)).alias("source")  # null-safe
    points = nodes.select(key, F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("x").isNotNull() & F.forall("x", lambda y: y.isNotNull()))
    lengths = points.groupBy("source").agg(F.min_by(F.size("x"), "id").alias("d"))
    points = points.join(lengths, "source").where(F.size("x") == F.col("d"))
    sizes = points.groupBy("source").agg(F.count("*").alias("points")).where("points >= 4")
    staged = points.join(sizes, "source").withColumn("h", F.xxhash64("id")).withColumn("chunk", F.pmod("h", F.ceil(F.col("points") / chunk)))
    staged = bucketed(staged.select("source", "chunk", "h", "id", "x", "points"), ["source", "chunk"], "mixture-points")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"])
        x = _matrix(pdf["x"])
        which, ll = fitted(x, x[: min(components, len(x) // 2)], turns, tolerance)
        return pd.DataFrame({"source": key[0], "id": pdf["id"], "cluster": which, "log_likelihood": ll})

    found = staged.where(F.col("points") <= chunk).groupBy("source", "chunk").applyInPandas(whole, _FOUND)
    large = staged.where(F.col("points") > chunk)
    if not large.isEmpty():
        found = found.unionByName(_turns(large, components, turns, tolerance))
    found = settled(found, "mixture-clusters").select(F.col("source").alias("_source"), F.col("id").alias("_id"), "cluster", "log_likelihood")
    plain = nodes.withColumns({"_source": F.to_json(F.struct(source)), "_id": F.col("id").cast("string")})
    return plain.join(found, ["_source", "_id"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0))).drop("_source", "_id")
