"""Checks on data, as queries whose rows are the findings."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that every filing's facts should hold.
IMPORTANT_TAGS = ("us-gaap:Revenue", "us-gaap:NetIncomeLoss", "us-gaap:Assets")


def coverage(docs: DataFrame, source: str = "source") -> DataFrame:  # V01
    return docs.agg(F.count("*").alias("entries"), F.count_distinct(F.nullif(source, F.lit(""))).alias("sources"))


def missing_sections(texts: DataFrame, expected: Sequence[str]) -> DataFrame:  # V02
    """source, section of every expected section of which no text speaks. texts: source, text."""
    wanted = F.array(*map(F.lit, expected))
    present = texts.select("source", F.filter(wanted, lambda s: F.contains(F.lower("text"), F.lower(s))).alias("s"))
    seen = present.groupBy("source").agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("seen"))
    return seen.select("source", F.explode(F.array_except(wanted, "seen")).alias("section"))


def table_counts(pages: DataFrame, parsed: DataFrame) -> DataFrame:  # V02
    """Tables in the HTML and tables parsed, per source."""
    n = pages.select("source", F.regexp_count("html", F.lit("(?i)<table[ >]")).cast("long").alias("in_html"))
    return n.join(parsed.groupBy("source").agg(F.count("*").alias("parsed")), "source", "left").na.fill(0, ["parsed"])


def missing_tags(facts: DataFrame, important: Sequence[str] = IMPORTANT_TAGS) -> DataFrame:  # V03, U04
    """source, tag of every important tag that a source's facts lack."""
    have = facts.groupBy("source").agg(F.collect_set(F.when(F.coalesce("name", "tag").isin(*important), F.coalesce("name", "tag"))).alias("have"))
    return have.select("source", F.explode(F.array_except(F.array(*map(F.lit, important)), "have")).alias("tag"))


def without_context(facts: DataFrame) -> DataFrame:  # V03
    return facts.where(F.coalesce("context", F.lit("")) == "")


def run_path(folder: str, run_id: str) -> str:  # P18
    """Where a run's file lies; an id that is no plain name, or leads out of the folder, is an error."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", run_id):
        raise ValueError("not a run id")
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, f"{run_id}.json"))
    if os.path.commonpath([root, path]) != root:
        raise ValueError("outside the folder")
    return path


def members_exist(folder: str, names: Sequence[str]) -> None:  # V05
    missing = [n for n in names if not os.path.isfile(os.path.join(folder, n))]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def vectors_by_id(vectors: DataFrame, ids: DataFrame, namespace: str) -> DataFrame:  # S17
    return vectors.where(F.col("namespace") == namespace).join(ids.select("id").distinct(), "id", "left_semi")


def namespace_counts(vectors: DataFrame) -> DataFrame:  # S18
    return vectors.groupBy("namespace").agg(F.count("*").alias("n"))
