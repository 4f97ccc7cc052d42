"""Vector codes by a codebook per part, trained with annular norm pruning.

Every vector is cut into equal parts; each part position has a codebook. A part's nearest entry is looked for among
entries sorted by norm: the entry of nearest norm gives a first distance d, and by the triangle inequality an entry
that is as near has a norm within d of the part's own. Two binary searches find that annulus, and only its entries
(both ends included) are evaluated, exactly, in integers.

A round is one pass: tasks assign parts and give sums per entry (a row per used entry and task), which Spark adds up.
The driver holds the codebooks and nothing else, ``PARTS * ENTRIES`` entries whatever the table's size.

Edges: rows whose vector is null or holds a null or non-finite component go. The first vector by vec_id whose length is a
positive multiple of the parts sets the length; vectors of another length have no place in the codebooks and go too. Null
vec_ids count after all others; rows of one vec_id count separately, in the order of their vectors. With fewer rows than
entries the codebooks are that short; equal entries tie, and the lower index wins. A component that reaches 2 ** 26 on the
lattice is refused with its vector. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .lattice import matrix, mean, on_lattice, squared

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Norms are square roots in floating point; the annulus is this much wider, relatively, than they say.
SLACK = 1e-9


def nearest(x: np.ndarray, book: np.ndarray, evaluated: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for every row of x (ties to the lower index), and the squared distance.
    evaluated: gets the number of distances that were computed."""
    norms = np.sqrt(np.einsum("ij,ij->i", book, book).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
    above = np.minimum(np.searchsorted(norms, own), len(norms) - 1)
    below = np.maximum(above - 1, 0)
    start = np.where(own - norms[below] < norms[above] - own, below, above)
    which = order[start]
    best = squared(x, book[which])
    reach = np.sqrt(best.astype(np.float64))
    reach += SLACK * (1 + own + reach)
    first, last = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    if evaluated is not None:
        evaluated.append(len(x))
    for place, entry in enumerate(order.tolist()):
        rows = np.flatnonzero((first <= place) & (place < last) & (start != place))
        if not len(rows):
            continue
        d = squared(x[rows], book[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < which[rows]))
        best[rows[better]], which[rows[better]] = d[better], entry
        if evaluated is not None:
            evaluated.append(len(rows))
    return which, best


def _assigned(batch: pa.RecordBatch, at: int, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each part position: the parts, their entries, their squared distances."""
    width = books[0].shape[1]
    v = matrix(batch.column(at), width * len(books))
    for m, book in enumerate(books):
        x = np.ascontiguousarray(v[:, m * width : (m + 1) * width])
        yield (x, *nearest(x, book))


def _improved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    size, width = books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), size), np.int64)
        total = np.zeros((len(books), size, width), np.int64)
        for b in batches:
            for m, (x, which, _) in enumerate(_assigned(b, 0, books)):
                count[m] += np.bincount(which, minlength=size)
                np.add.at(total[m], which, x)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]), "s": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))})

    told = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, s array<long>")
    told = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)))
    out = [b.copy() for b in books]
    for row in told.collect():  # a row per used entry
        out[row.part][row.entry] = [mean(row[f"s{i}"], row.n) for i in range(width)]
    return out


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The vectors (vec_id, v, others) that have the codebooks' length, and a codebook per part position."""
    first = F.col("vec_id").asc_nulls_last(), F.col("v").asc()
    whole = vectors.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    length = whole.orderBy(*first).select(F.size("v")).limit(1).collect()
    if not length:
        return whole, []
    whole = whole.where(F.size("v") == length[0][0])
    start = np.array([r.v for r in whole.orderBy(*first).select("v").limit(entries).collect()], np.int64)
    books = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _improved(whole, books)
    return whole, books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, distance = zip(*((w, d) for _, w, d in _assigned(b, 2, books)))
            code = [bytes(x).hex() for x in np.stack(which, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(np.sum(distance, axis=0))], names=["vec_id", "label", "code", "error"])

    plain = vectors.select("vec_id", "label", "v")
    kinds = dict(plain.dtypes)
    return plain.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that a code stands for: the middle of each lattice cell."""
    table = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / scale) for x in row)) for row in b)) for b in books))
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda m: F.get(F.get(table, m), F.conv(F.substring("code", m * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.select("vec_id", F.flatten(parts).alias("vector"))


def coded(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error over equal labels, nulls together), codebooks_sha256."""
    vectors, books = trained(on_lattice(embeddings, SCALE, keep=("vec_id", "label")))
    if not books:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    codes = settle(encode(vectors, books), "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
