"""Tables stored by key that several writers may change at once.

Rows lie in buckets by a hash of the key. A commit rewrites the buckets that its rows touch into a folder of its own, and
puts one version file in place that names every bucket's folder. The file's number must be free: if another writer was
first, the commit looks at the new version. Where that left the touched buckets alone, only the version file is written
anew; else the buckets are merged again, with what the other has stored. So no row is lost and no key comes twice, and a
reader always sees one version. A job that fails on the way leaves the old version as it was.

Null keys are equal to each other. Of rows that arrive with one key the first by ``order`` counts, equals by a hash of all
columns. Columns that the table lacks or that rows lack are an error before anything is written."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import relational
from .workspace import filesystem, place_once, put, read_text, settled

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], buckets: int = BUCKETS):
        """buckets: of a table that does not exist yet."""
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), list(key), buckets

    def _file(self, path, version: int):
        return path(f"{self.root}/_versions/v{version:012d}.json")

    def versions(self) -> list[int]:
        fs, path = filesystem(self.spark, self.root)
        at = path(f"{self.root}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """A version's number and what it names: buckets, schema, parts (bucket: folder). Version 0 is empty."""
        fs, path = filesystem(self.spark, self.root)
        v = version if version is not None else (self.versions() or [0])[-1]
        return v, json.loads(read_text(fs, self._file(path, v))) if v else {"buckets": self.buckets, "schema": None, "parts": {}}

    def _rows(self, state: dict, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
        parts = state["parts"]
        folders = [f"{self.root}/{parts[b]}" for b in (parts if buckets is None else map(str, buckets)) if b in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, the last one by default."""
        _, state = self.state(version)
        if state["schema"] is None:
            raise LookupError(f"{self.root} holds no version")
        return self._rows(state, StructType.fromJson(state["schema"]))

    def _checked(self, df: DataFrame, state: dict) -> StructType:
        known = StructType.fromJson(state["schema"]) if state["schema"] else StructType([f for f in df.schema.fields])
        differ = set(df.columns) ^ set(known.names)
        if differ or (missing := set(self.key) - set(df.columns)):
            raise ValueError(f"columns of {self.root} and of the rows differ: {', '.join(sorted(differ or missing))}")
        return known

    def _place(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _commit(self, df: DataFrame, order: Sequence[str | Column], replace: bool) -> tuple[int, list[int]]:
        """The new version and the buckets touched."""
        fs, path = filesystem(self.spark, self.root)
        _, state = self.state()
        schema = self._checked(df, state)
        arriving = settled(df.select(*schema.names), "arriving")
        made: dict[str, str] = {}
        seen: dict | None = None  # what the merge was based on
        touched: list[int] = []
        draft = path(f"{self.root}/_drafts/{uuid.uuid4().hex}.json")
        fs.mkdirs(path(f"{self.root}/_versions"))
        done = False
        try:
            while True:
                version, state = self.state()
                n = state["buckets"]
                if seen is None or n != seen["buckets"] or any(state["parts"].get(str(b)) != seen["parts"].get(str(b)) for b in touched):
                    self._drop(fs, path, made)
                    schema = self._checked(df, state)
                    touched = sorted(r[0] for r in arriving.select(self._place(n).alias("b")).distinct().collect())  # as many as buckets
                    made, seen = self._merged(arriving, state, schema, touched, order, replace), state
                put(fs, draft, json.dumps({"buckets": n, "schema": schema.jsonValue(), "parts": state["parts"] | made}))
                if place_once(fs, draft, self._file(path, version + 1)):
                    done = True
                    return version + 1, touched
        finally:
            fs.delete(draft, False)
            if not done:
                self._drop(fs, path, made)

    def _merged(self, arriving: DataFrame, state: dict, schema: StructType, touched: list[int], order: Sequence[str | Column], replace: bool) -> dict[str, str]:
        """The touched buckets with the arriving rows, in a new folder. One aggregation by key: null keys meet, too."""
        stored = self._rows(state, schema, touched).withColumn("_turn", F.lit(int(replace)))
        both = stored.unionByName(arriving.withColumn("_turn", F.lit(int(not replace))))
        best = [F.col(o) if isinstance(o, str) else o for o in order]
        first = F.min_by(F.struct(*schema.names), F.struct(F.col("_turn"), *best, F.xxhash64(*schema.names)))
        rows = both.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.key))).agg(first.alias("_row")).select("_row.*")
        folder = f"_data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._place(state["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {str(b): f"{folder}/_bucket={b}" for b in touched}

    def _drop(self, fs, path, parts: dict[str, str]) -> None:
        for folder in {p.rsplit("/", 1)[0] for p in parts.values()}:
            fs.delete(path(f"{self.root}/{folder}"), True)

    def insert_absent(self, df: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:  # K02-K05
        """Adds rows whose key is not stored, and gives back the stored rows of every passed key."""
        version, touched = self._commit(df, order, replace=False)
        _, state = self.state(version)
        stored = self._rows(state, StructType.fromJson(state["schema"]), touched)
        keys = df.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.key))).distinct()
        same = reduce(lambda a, b: a & b, (stored[k].eqNullSafe(keys[f"_key{i}"]) for i, k in enumerate(self.key)))
        return stored.join(keys, same, "left_semi")

    def upsert(self, df: DataFrame, order: Sequence[str | Column] = ()) -> int:  # K08, K12
        """Stores rows in place of those with their key; returns the version."""
        return self._commit(df, order, replace=True)[0]

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions older than the last ``keep`` and the buckets that only they name; returns how many folders went.
        What writers have not committed is in no version and stays."""
        fs, path = filesystem(self.spark, self.root)
        known = self.versions()
        named = {v: set(self.state(v)[1]["parts"].values()) for v in known}
        live = set().union(*(named[v] for v in known[-keep:])) if known else set()
        gone = set().union(*(named[v] for v in known[:-keep])) - live if known[:-keep] else set()
        for part in gone:
            fs.delete(path(f"{self.root}/{part}"), True)
        for v in known[:-keep]:
            fs.delete(self._file(path, v), False)
        return len(gone)
