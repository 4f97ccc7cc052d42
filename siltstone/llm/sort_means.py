"""Centroid clustering by sort-means.

Each round orders, for every centroid, the others by their distance from it. A vector starts at the centroid that it was
assigned to before, at distance d, and goes through the others in that order; as soon as one lies strictly beyond 2 d from
the first, neither it nor any later one can be as near as d, and the scan stops. What is evaluated is evaluated in
integers, ties go to the smaller number.

A round is one narrow pass over the vectors and their assignments, written to the shared folder, and one aggregation of
sums per centroid. The driver holds the centroids (``CENTROIDS`` rows whatever the table's size).

Edges: rows go unless their vector has exactly ``DIMENSIONS`` components, none of them null or non-finite. Null vec_ids come
last among the first centroids; rows of one vec_id count separately, in the order of their vectors. With fewer rows than
centroids there are that many centroids; equal centroids tie, and the smaller number wins; an empty one stays where it is.
A component that reaches 2 ** 26 on the lattice is refused with its vector. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import workspace
from .common import scratch
from .lattice import matrix, mean, on_lattice, squared

SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 256, 64, 40, 5
SEED = "2:"


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, evaluated: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row of x, and the squared distance; before: where the scans start.
    evaluated: gets the number of distances that were computed."""
    apart = np.stack([squared(centroids, c) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    which, best = before.copy(), np.zeros(len(x), np.int64)
    for a in np.unique(before).tolist():
        rows = np.flatnonzero(before == a)
        y = x[rows]
        own = squared(y, centroids[a])
        least, number, live = own.copy(), np.full(len(rows), a), np.arange(len(rows))
        if evaluated is not None:
            evaluated.append(len(rows))
        for j in order[a].tolist():
            if j == a:
                continue
            live = live[apart[a, j] <= 4 * own[live]]
            if not len(live):
                break
            d = squared(y[live], centroids[j])
            better = (d < least[live]) | ((d == least[live]) & (j < number[live]))
            hit = live[better]
            least[hit], number[hit] = d[better], j
            if evaluated is not None:
                evaluated.append(len(live))
        which[rows], best[rows] = number, least
    return which, best


def _assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, v, cluster, distance; state has the cluster before."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, distance = nearest(matrix(b.column(1), width), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(which, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    plain = state.select("vec_id", "v", "cluster")
    return plain.mapInArrow(run, f"vec_id {dict(plain.dtypes)['vec_id']}, v array<long>, cluster int, distance long")


def clusters(vectors: DataFrame, dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """The vectors (vec_id, v) of that many components with cluster and distance, and the final centroids. Of the rounds'
    tables only the last one stays: the one before it goes once the next is written."""
    spark = vectors.sparkSession
    whole = vectors.where(F.size("v") == dimensions)
    start = whole.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").select("v").limit(k).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, dimensions)
    state, before = whole.select("vec_id", "v", F.lit(0).alias("cluster")), None
    if not len(centroids):
        return state.withColumn("distance", F.lit(0).cast("long")), centroids
    for done in range(rounds + 1):
        path = scratch(spark, "sort-means")
        out = _assigned(state, centroids)
        out.write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            workspace.drop(spark, before)
        before = path
        if done < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dimensions)))
            for row in sums.collect():  # a row per centroid
                centroids[row.cluster] = [mean(row[f"s{i}"], row.n) for i in range(dimensions)]
    return state, centroids


def clustered(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    found, centroids = clusters(on_lattice(embeddings, SCALE))
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance").alias("inertia"))
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    names = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    told = by_cluster.join(names, "cluster").crossJoin(total)  # a row per centroid, and one row
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
