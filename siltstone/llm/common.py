"""Shared helpers of the training-data operators: input columns, scratch tables, token files."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import workspace
from ..sources.tables import table

#: What counts as a space between words in every operator of this package.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``); see ``workspace.folder``."""
    return workspace.folder(spark, what)


def settle(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can
    reread the result after another one is lost. files: for results of few rows, how many files hold
    them, whatever the number of shuffle partitions."""
    spark = df.sparkSession
    path = scratch(spark, what)
    out = df if files is None else df.coalesce(files)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(spark: SparkSession, rows: int, per_file: int = 100_000) -> int:
    return max(1, min(parts(spark), -(-rows // per_file)))


BLOCK_BITS = 10  # rows of a block: 2 ** BLOCK_BITS consecutive ones of a partition at most, unless a caller sets other bits
BLOCK_BYTES = 8 << 20  # and about this many bytes, or one longer row


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which Spark puts a long: its Murmur3 hash with seed 42, modulo the buckets. Were it another, blocks
    would only lie in more files."""
    x = x.astype(np.uint64)
    rotl = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.full(len(x), 42, np.uint32)
    for half in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        k = rotl(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotl(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return np.mod((h ^ (h >> np.uint32(16))).view(np.int32), buckets)


def block_numbers(part: int, buckets: int, of_part: int) -> Iterator[int]:
    """Ascending block numbers of a scan partition that all lie in ``of_part`` buckets, by turns: a task writes that many
    files, however many blocks it has."""
    own = [(part * of_part + k) % buckets for k in range(of_part)]
    at, turn = part << 32, 0
    while True:
        some = np.arange(at, at + (1 << 14), dtype=np.int64)
        place = bucket_of(some, buckets)
        i = 0
        while len(hit := np.flatnonzero(place[i:] == own[turn])):
            i += int(hit[0]) + 1
            yield int(some[i - 1])
            turn = (turn + 1) % of_part
        at += 1 << 14


def row_numbers(df: DataFrame, most: int = BLOCK_BYTES, bits: int = BLOCK_BITS) -> Callable[[], Callable[[pa.Array], pa.Array]]:
    """For tasks over the partitions of ``df``: makes a function that numbers rows in the order of the scan, batch by
    batch, from their texts. A number's upper bits are the block, whose rows hold at most ``most`` bytes together, unless
    a single one holds more."""
    buckets = buckets_of(df.sparkSession)
    of_part = max(1, buckets // max(1, df._jdf.queryExecution().toRdd().getNumPartitions()))

    def begin() -> Callable[[pa.Array], pa.Array]:
        blocks = block_numbers(TaskContext.get().partitionId(), buckets, of_part)
        block, place, size = next(blocks), 0, 0

        def number(texts: pa.Array) -> pa.Array:
            nonlocal block, place, size
            rows = []
            for n in pc.fill_null(pc.binary_length(texts), 0).to_pylist():
                if place == 1 << bits or (place and size + n > most):
                    block, place, size = next(blocks), 0, 0
                rows.append(block << bits | place)
                place, size = place + 1, size + n
            return pa.array(rows, pa.int64())

        return number

    return begin


def numbered(df: DataFrame, body: str, most: int = BLOCK_BYTES, bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with a ``row`` of ``row_numbers`` in front. No shuffle, nothing kept but a counter."""
    at, begin = df.columns.index(body), row_numbers(df, most, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = begin()
        for b in batches:
            yield pa.RecordBatch.from_arrays([number(b.column(at)), *b.columns], names=["row", *b.schema.names])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(["row long", *(f"`{c}` {kinds[c]}" for c in df.columns)]))


def buckets_of(spark: SparkSession) -> int:
    return max(8, parts(spark))


def in_blocks(df: DataFrame, what: str, bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` (with a ``row`` of ``numbered``) as a table in the shared folder, bucketed by ``block``. Written
    without a shuffle; later joins and groups by block read the texts in place, and ``row`` is fixed."""
    spark = df.sparkSession
    name = f"siltstone_{uuid.uuid4().hex}"
    blocks = df.withColumn("block", F.shiftright("row", bits))
    blocks.write.bucketBy(buckets_of(spark), "block").sortBy("block").option("path", scratch(spark, what)).option("compression", "zstd").saveAsTable(name)
    workspace.made_table(name)
    return spark.table(name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the operator of a cluster sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))
