"""Exact search over vectors in inverted lists, of which most need not be read.

Vectors lie at unit length in lists around centroids (from a bounded sample), each with its distance from its centroid.
For a question at distance ``a`` from a centroid, a vector at distance ``g`` from the same centroid is at least
``|a - g|`` away, so its cosine is at most ``1 - (a - g) ** 2 / 2``. The lists that promise most are read first; the k-th
best score there rules out every list, and every vector of the other lists, whose bound lies below it. What is left is
scored. Lists are partitions of the table on disk: those that no question needs are not opened.

Of vectors with equal components and equal kept columns only the ``deepest`` smallest keys are stored, as the others
cannot be among the k best (k <= deepest), so one very common vector makes no hot list. Null vectors, those with a null or
NaN component or of another length than the first key's have no score and are not found; a zero vector scores 0
with everything, as a zero question does."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import norm, unit
from ..sources.workspace import folder, settled
from . import relational
from .retrieval import date_filter, metadata_filter

MOST_LISTS, SAMPLE_PER_LIST, TURNS, DEEPEST = 4096, 64, 6, 100
VECTORS, QUESTIONS = 1024, 256  # of a block
ZERO = -1  # the list of zero vectors
#: Scores are rounded to six digits before they are ranked; a bound must lie below by more than rounding can add.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # list, key, kept columns, point (unit length), gap (distance from the list's centroid)
    lists: DataFrame  # list, centroid, n, least and most gap: a row per list
    key: str
    keep: tuple[str, ...]
    deepest: int


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _listed(points: DataFrame, key: str, lists: int) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """The points with the number of their list, and the centroids: those of a sample of about SAMPLE_PER_LIST points a
    list, chosen by a hash of the key. It is all that is fitted, and results do not depend on it."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if lists < 2:  # any centroid will do
        return points.withColumn("list", F.lit(0)), [(0, points.agg(F.min_by("point", key)).first()[0])]
    rate = max(1, points.count() // (SAMPLE_PER_LIST * lists))
    features = points.withColumn("features", array_to_vector("point"))
    sample = features.where(F.pmod(F.xxhash64(key), F.lit(rate)) == 0)
    model = KMeans(k=lists, maxIter=TURNS, seed=42, initMode="random", predictionCol="list").fit(features if sample.isEmpty() else sample)
    return model.transform(features).drop("features"), [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]


def build(vectors: DataFrame, key: str, vector: str = "embedding", keep: Sequence[str] = (), lists: int | None = None, deepest: int = DEEPEST) -> VectorIndex:
    """Indexes every row of ``vectors`` in the shared folder. lists: half the square root of the rows by default, never
    more than MOST_LISTS."""
    spark, x = vectors.sparkSession, F.col("_x")
    sound = vectors.select(key, *keep, F.col(vector).cast("array<double>").alias("_x")).where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y)))
    length = sound.agg(F.min_by(F.size(x), key)).first()[0]
    sound = sound.where(F.size(x) == F.lit(length))
    first = relational.top_per(sound, ["_x", *keep], [F.col(key)], deepest, "_copy").drop("_copy")
    points = settled(first.select(key, *keep, unit(x).alias("point"), (norm(x) == 0).alias("_zero")), "points")
    n = points.where("not _zero").count()
    schema = "list int, centroid array<double>"
    lengthy = points.where("not _zero").drop("_zero")
    listed, centres = _listed(lengthy, key, lists or min(MOST_LISTS, max(1, round(n**0.5 / 2)))) if n else (lengthy.withColumn("list", F.lit(0)), [])
    centroids = spark.createDataFrame(centres, schema)
    away = listed.join(F.broadcast(centroids), "list").withColumn("gap", _apart(F.col("point"), F.col("centroid"))).drop("centroid")
    zeros = points.where("_zero").drop("_zero").select("*", F.lit(ZERO).alias("list"), F.lit(0.0).alias("gap"))
    path = folder(spark, "vector-index")
    # a list's rows meet in few files; a list too large for one is split among several
    away.unionByName(zeros).hint("rebalance", "list").sortWithinPartitions("list", "gap").write.partitionBy("list").parquet(path)
    stored = spark.read.schema(T.StructType([*points.drop("_zero").schema.fields, T.StructField("gap", T.DoubleType()), T.StructField("list", T.IntegerType())])).parquet(path)
    sizes = stored.groupBy("list").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return VectorIndex(stored, settled(sizes.join(centroids, "list", "left"), "lists"), key, tuple(keep), deepest)


def _reach(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """qid, list, n, away (the question's distance from the centroid) and best (the highest score that a vector of the
    list can have). The table of lists is broadcast: MOST_LISTS rows at most."""
    met = asked.crossJoin(F.broadcast(index.lists)).withColumn("away", _apart(F.col("query"), F.col("centroid")))
    clear = F.greatest(F.lit(0.0), F.col("away") - F.col("most"), F.col("least") - F.col("away"))
    flat = (F.col("list") == ZERO) | (norm(F.col("query")) == 0)
    return met.select("qid", "list", "n", F.when(~flat, F.col("away")).alias("away"), F.when(flat, 0.0).otherwise(1 - clear * clear / 2).alias("best"))


def _packed(df: DataFrame, rows: Sequence[str], matrix: str, numbers: Sequence[str], size: int) -> DataFrame:
    """Rows of a list, up to ``size`` neighbours of a partition at a time, as one row: list, their ``rows`` columns as structs,
    their vectors and numbers (null as NaN) as packed doubles. In place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(0).to_numpy()
            at = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
            cuts = [c for a, e in zip(at.tolist(), [*at[1:].tolist(), len(lists)]) for c in range(a, e, size)]
            ends = [*cuts[1:], len(lists)]
            structs = pa.StructArray.from_arrays([b.column(c) for c in rows], names=list(rows))
            points = b.column(matrix).flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            columns = [pa.array(lists[cuts], pa.int32()), pa.ListArray.from_arrays(pa.array([*cuts, len(lists)], pa.int32()), structs), pa.array([points[a:e].tobytes() for a, e in zip(cuts, ends)], pa.binary())]
            for c in numbers:
                x = b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                columns.append(pa.array([x[a:e].tobytes() for a, e in zip(cuts, ends)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["list", "rows", matrix, *numbers])

    kinds = dict(df.dtypes)
    inner = ", ".join(f"`{c}`: {kinds[c]}" for c in rows)
    return df.select("list", *rows, matrix, *numbers).mapInArrow(run, f"list int, rows array<struct<{inner}>>, {matrix} binary, " + ", ".join(f"{c} binary" for c in numbers))


def _scored(index: VectorIndex, asked: DataFrame, probes: DataFrame, spec: Mapping | None, digits: int, k: int | None) -> DataFrame:
    """qid, key, kept columns, score of the vectors of the probed lists (qid, list, away, floor) that reach the floor; of a
    block of vectors no more than k for a question. A block of vectors meets a block of questions as two matrices, so
    pairs are never rows."""
    lists = [r[0] for r in probes.select("list").distinct().collect()]  # MOST_LISTS at most
    names, key = (index.key, *index.keep), index.key
    rows = _packed(index.vectors.where(F.col("list").isin(lists)).where(metadata_filter(spec)), names, "point", ["gap"], VECTORS)
    dealt = probes.join(asked, "qid").repartition("list", F.pmod(F.xxhash64("qid"), F.lit(8))).sortWithinPartitions("list")
    pairs = rows.join(_packed(dealt, ["qid"], "query", ["away", "floor"], QUESTIONS).withColumnRenamed("rows", "asked"), "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                vectors, questions = b.column(0)[i].values, b.column(1)[i].values
                points, gap, query, away, floor = (np.frombuffer(b.column(c)[i].as_py(), np.float64) for c in range(2, 7))
                open_ = np.isnan(away) | np.isnan(floor)
                reach = open_[:, None] | (1 - (away[:, None] - gap[None]) ** 2 / 2 >= np.where(open_, 0, floor)[:, None] - SLACK)
                cols = pc.sort_indices(vectors.field(key)).to_numpy()  # ties go to the smaller key
                cols = cols[reach.any(axis=0)[cols]]
                if not len(cols):
                    continue
                score = np.round(query.reshape(len(questions), -1) @ points.reshape(len(vectors), -1)[cols].T, digits) + 0.0
                score = np.where(reach[:, cols] & (np.isnan(floor)[:, None] | (score >= floor[:, None])), score, -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, : k or len(cols)]
                top = np.take_along_axis(score, best, axis=1)
                q, place = np.nonzero(top > -np.inf)
                if len(q):
                    found = vectors.take(pa.array(cols[best[q, place]]))
                    yield pa.RecordBatch.from_arrays([questions.field("qid").take(pa.array(q)), *(found.field(c) for c in names), pa.array(top[q, place])], names=["qid", *names, "score"])

    kinds = dict(index.vectors.dtypes)
    schema = ", ".join([f"qid {dict(probes.dtypes)['qid']}", *(f"`{c}` {kinds[c]}" for c in names), "score double"])
    return pairs.select("rows", "asked", "point", "gap", "query", "away", "floor").mapInArrow(run, schema)


def _asked(queries: DataFrame) -> DataFrame:
    q = queries.where(F.col("query").isNotNull()).select("qid", unit(F.col("query")).alias("query"))
    return settled(relational.keep_first(q, ["qid"], ["query"]), "questions")


def _first_lists(reach: DataFrame, k: int) -> DataFrame:
    """The lists that promise most, as many as hold k vectors."""
    order = [F.desc("best"), F.col("list")]
    ranked = relational.running(reach, ["qid"], order, "n", "_before")
    return ranked.where(F.col("_before") < k).select("qid", "list", "away", F.lit(None).cast("double").alias("floor"))


def search(index: VectorIndex, queries: DataFrame, k: int, spec: Mapping | None = None, digits: int = 6) -> DataFrame:  # R01, J12
    """qid, key, kept columns, score, rank: the k best of each question (qid, query), exactly, ties to the smaller key. spec:
    a filter over kept columns that stands before top k. Null questions find nothing; of rows that share a qid one counts."""
    if k > index.deepest:
        raise ValueError(f"the index holds {index.deepest} of equal vectors, too few for the best {k}")
    asked = _asked(queries)
    reach = settled(_reach(index, asked), "reach")
    first = _first_lists(reach, k)
    order = [F.desc("score"), F.col(index.key)]
    best = settled(relational.top_per(_scored(index, asked, first, spec, digits, k), ["qid"], order, k), "first-hits").drop("rank")
    floors = best.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = reach.join(first.select("qid", "list"), ["qid", "list"], "left_anti").join(floors, "qid", "left")
    rest = rest.where(F.col("floor").isNull() | (F.col("best") >= F.col("floor") - SLACK)).select("qid", "list", "away", "floor")
    return relational.top_per(best.unionByName(_scored(index, asked, settled(rest, "probes"), spec, digits, k)), ["qid"], order, k)


def within(index: VectorIndex, queries: DataFrame, least: float, spec: Mapping | None = None, digits: int = 6) -> DataFrame:
    """qid, key, kept columns, score of all stored vectors with a score of ``least`` or more."""
    asked = _asked(queries)
    probes = _reach(index, asked).where(F.col("best") >= least - SLACK).select("qid", "list", "away", F.lit(least).alias("floor"))
    return _scored(index, asked, settled(probes, "probes"), spec, digits, None)


def retrieve(index: VectorIndex, queries: DataFrame, k: int, spec: Mapping | None = None, date: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:  # R07
    """A corpus's results for many questions: filter, top k, then the span of days (a missing date fails a lower bound)."""
    found = search(index, queries, k, spec)
    return found.where(date_filter(F.col(date), start, end)) if date else found


def looked_at(index: VectorIndex, queries: DataFrame, k: int) -> tuple[int, int]:
    """Of all pairs of a question and a stored vector, how many lie in lists that ``search`` reads, and how many there are."""
    asked = _asked(queries)
    reach = settled(_reach(index, asked), "reach")
    best = search(index, queries, k)
    floors = best.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    read = reach.join(floors, "qid", "left").where(F.col("floor").isNull() | (F.col("best") >= F.col("floor") - SLACK)).agg(F.sum("n")).first()[0]
    return read or 0, reach.agg(F.sum("n")).first()[0] or 0
