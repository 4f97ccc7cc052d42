"""From raw documents to packed token sequences: quality rules, near copies, repeated passages, personal data, packing.

Edges, of every stage: null and empty texts are texts without words (the quality rules drop them; a later stage that meets
them keeps them, and they are packed as their end sign alone); a null doc_id, language or source stays null; rows that repeat
a doc_id or a text count separately until near copies go, of which one stays; very long texts are worked on whole;
an empty table gives an empty one; of the input only COLUMNS are read, so other columns may have any name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents, scratch
from siltstone.llm.jaccard_join import keep_one
from siltstone.llm.packing import pack
from siltstone.llm.pii import redact
from siltstone.llm.quality_ledger import keep_good
from siltstone.llm.queries import vocabulary
from siltstone.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return keep_good(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, the one with the smallest doc_id stays."""
    return keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier too go; so does a document of which nothing is left."""
    left = remove_repeats(docs, carry=("lang", "source"), with_text=True)
    left = left.where((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal identifier gives way to its kind in angle brackets."""
    return redact(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]

#: Components, suffix order, pattern scores and packing are not for SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
