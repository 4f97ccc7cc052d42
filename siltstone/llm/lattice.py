"""Vectors on an integer lattice: what the vector operators share.

Integers make sums independent of the order in which tasks finish, so a lost executor changes no result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components at or beyond this lie outside of what 64-bit squares hold; they are refused.
LARGEST = 1 << 26


def on_lattice(vectors: DataFrame, scale: int, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``keep``, and ``v``: floor(scale * x) of every component. Rows whose vector is null or holds a null or
    non-finite component go. Built-in functions only."""
    given = vectors.select(*keep, F.col(vector).cast("array<double>").alias("x"))
    sound = F.col("x").isNotNull() & F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    refused = F.raise_error(F.concat(F.lit(f"a component times {scale} reaches {LARGEST}: "), F.to_json(F.struct("x")))).cast("array<bigint>")
    # the optimizer may ask for v before the rows are filtered
    v = F.when(sound & F.exists("x", lambda y: F.abs(y * scale) >= LARGEST), refused).otherwise(F.transform("x", lambda y: F.floor(y * scale)))
    return given.where(sound).select(*keep, v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` longs as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from y (a row, or rows of the same number)."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def mean(total: int, count: int) -> int:
    return total // count
