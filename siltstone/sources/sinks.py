"""Sinks. Parquet has no transaction over tables: they are written, checked, and shown by one file that names them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational
from .keyed import KeyedTable
from .workspace import filesystem, place_once, put, read_text


class MissingColumns(ValueError):
    pass


def append(df: DataFrame, path: str, columns: list[str]) -> None:  # K01, K06, V04
    """Appends the stated columns; a missing one is an error before anything is written."""
    missing = relational.missing_columns(df, columns)
    if missing:
        raise MissingColumns(", ".join(missing))
    df.select(*columns).write.mode("append").parquet(path)


def insert_absent(df: DataFrame, path: str, key: list[str]) -> DataFrame:  # K02-K05
    """Adds rows whose key is not there, and gives back the stored rows of every passed key; several writers may do so at
    once. ``KeyedTable(spark, path, key).read()`` reads the table."""
    return KeyedTable(df.sparkSession, path, key).insert_absent(df)


def append_once(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows that are not stored yet: a repeated load changes nothing."""
    insert_absent(df, path, key)


def _versions(fs, path, root: str) -> list[int]:
    at = path(f"{root}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Where the tables lie that were published last: name, path. One file names them all, so a reader sees tables
    of one publication."""
    fs, path = filesystem(spark, root)
    known = _versions(fs, path, root)
    return {n: f"{root}/{p}" for n, p in json.loads(read_text(fs, path(f"{root}/_versions/v{known[-1]:012d}.json"))).items()} if known else {}


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(published(spark, root)[name])


def publish(tables: dict[str, DataFrame], root: str, checks: list[tuple[str, str, str, str]] = (), keep: int = 2) -> int:  # K07, V06
    """Writes tables together and returns the version: all go to a folder of their own, references (child, column,
    parent, column) are checked on what was written, then one file that names every table's folder is put in place,
    which fails if another writer was first (then it is tried with the next number). Tables that are not passed stay as
    they were. Any failure before leaves the old version; folders older than ``keep`` versions go afterwards."""
    spark = next(iter(tables.values())).sparkSession
    fs, path = filesystem(spark, root)
    new = {name: f"_data/{uuid.uuid4().hex}/{name}" for name in tables}
    draft, done = path(f"{root}/_drafts/{uuid.uuid4().hex}.json"), False
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/{new[name]}")
        for child, column, parent, parent_column in checks:
            bad = relational.orphans(spark.read.parquet(f"{root}/{new[child]}"), column, spark.read.parquet(f"{root}/{new[parent]}"), parent_column)
            if bad.limit(1).count():
                raise ValueError(f"{child}.{column} refers to rows that {parent} lacks")
        fs.mkdirs(path(f"{root}/_versions"))
        while not done:
            version = (_versions(fs, path, root) or [0])[-1] + 1
            put(fs, draft, json.dumps({n: p.removeprefix(f"{root}/") for n, p in published(spark, root).items()} | new))
            done = place_once(fs, draft, path(f"{root}/_versions/v{version:012d}.json"))
    finally:
        fs.delete(draft, False)
        if not done:
            for p in new.values():
                fs.delete(path(f"{root}/{p}").getParent(), True)
    # only what a version that falls away named, and no later one does, is deleted: other writers' folders are in none
    known = _versions(fs, path, root)
    named = {v: set(json.loads(read_text(fs, path(f"{root}/_versions/v{v:012d}.json"))).values()) for v in known}
    live = set().union(*(named[v] for v in known[-keep:]))
    for v in known[:-keep]:
        for p in named[v] - live:
            fs.delete(path(f"{root}/{p}").getParent(), True)
        fs.delete(path(f"{root}/_versions/v{v:012d}.json"), False)
    return version


def upsert_vectors(existing: DataFrame, arriving: DataFrame, order: str) -> DataFrame:  # K08
    """The last write of each id in a namespace wins."""
    key = ["namespace", "id"]
    return relational.upsert(existing, relational.keep_last(arriving, key, [order]).select(*existing.columns), key)


def json_lines(df: DataFrame, path: str) -> None:  # K09, K11
    """One JSON object a line, null keys left out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)


def replaced_by_source(existing: DataFrame, arriving: DataFrame) -> DataFrame:  # K10
    return relational.upsert(existing, arriving, ["source"])
