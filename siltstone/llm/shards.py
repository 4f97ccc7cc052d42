"""Sharding by size-tiered compaction.

A table is a folder of immutable shards and of numbered manifests. Arrivals are appended as small shards.
Compaction takes each tier of similarly sized shards (tiers are powers of ``fan_in`` above ``small``
bytes), and, where a tier has at least ``fan_in`` of them, merges them into files of about the target
size. A new state is a new manifest, put in place by one operation that fails if the version exists already:
readers see the old or the new state, and a writer who lost the race plans anew.

That operation is a hard link on local files and a rename on HDFS and the stores that rename like it, which
both refuse an existing target; other filesystems, whose rename copies or replaces, are refused.

A writer leaves an intent before it writes a folder of shards and takes it away after its commit. ``vacuum``
removes what neither a kept manifest names nor an intent protects; an intent older than ``stale_s`` is what a
dead writer left.

Merging shuffles nothing: a scan whose split size is the target packs whole small files of a tier into
tasks of at most the target size, and each task writes one file. The driver handles names, sizes and row
counts of shards, never rows: at the default target 100 TB are about 800,000 entries.

Edges: an empty arrival leaves the table as it is, with no new shard; nulls and repeated rows are stored as they
come; a column that the table lacks is added to its schema (null in older rows), a column that an arrival lacks
is null in its rows; a column of another type, or whose name differs in case only, is refused before anything
is written; rows are counted before and after each merge, and a difference aborts it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.workspace import filesystem, place_once, put, read_text

DAY = 86_400


@dataclass(frozen=True)
class Shard:
    path: str  # below the table's root
    bytes: int
    rows: int


class Conflict(RuntimeError):
    """Another writer has committed first."""


class SchemaClash(TypeError):
    """An arrival's column has another type, or another case, than the table's."""


def merged_schema(said: str | None, new: StructType) -> str:
    """The table's schema with the arrival's further columns behind; all may be null."""
    have = [] if said is None else list(_schema(said).fields)
    known = {f.name.lower(): f for f in have}
    for f in new.fields:
        old = known.get(f.name.lower())
        if old is None:
            known[f.name.lower()] = f
            have.append(f)
        elif old.name != f.name or old.dataType != f.dataType:
            raise SchemaClash(f"the table has {old.name} {old.dataType.simpleString()}, the arrival {f.name} {f.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in have]).json()


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, small: int = 64 << 10, fan_in: int = 4):
        self.spark, self.root, self.target, self.small, self.fan_in = spark, root.rstrip("/"), target, small, fan_in
        self._fs, self._path = filesystem(spark, self.root)

    # -- manifests ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """Version, live shards and the rows' schema (JSON); version 0 is the empty table."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return 0, [], None
        said = json.loads(read_text(self._fs, self._path(f"{self.root}/manifests/v{version:012d}.json")))
        return version, [Shard(**s) for s in said["shards"]], said["schema"]

    def _commit(self, version: int, shards: list[Shard], schema: str) -> int:
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}.json"
        put(self._fs, self._path(draft), json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}))
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        final = f"{self.root}/manifests/v{version:012d}.json"
        try:
            if not place_once(self._fs, self._path(draft), self._path(final)):
                raise Conflict(f"version {version} exists")
        finally:
            self._fs.delete(self._path(draft), False)
        return version

    def _change(self, change: Callable[[list[Shard], str | None], tuple[list[Shard], str]], tries: int = 20) -> int:
        """Commits change(live shards, schema), which is asked again after another writer's commit."""
        for _ in range(tries):
            version, live, said = self.manifest()
            try:
                return self._commit(version + 1, *change(live, said))
            except Conflict:
                continue
        raise Conflict("gave up after other writers' commits")

    # -- shards ------------------------------------------------------------------------------

    def _written(self, folder: str) -> list[Shard]:
        """The files of a finished write that hold rows, with their sizes and row counts."""
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getPath().getName().endswith(".parquet")]
        if not found:
            return []
        files = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("f")).count()
        rows = {r["f"]: r["count"] for r in files.collect()}  # one row a shard: the manifest's own size
        return [Shard(f"{folder}/{n}", size, rows[n]) for n, size in sorted(found) if rows.get(n)]

    def _folder(self, what: str) -> str:
        """A new folder of shards, protected by an intent until ``_done``."""
        name = f"{what}-{uuid.uuid4().hex}"
        put(self._fs, self._path(f"{self.root}/intents/{name}"), repr(time.time()))
        return f"shards/{name}"

    def _done(self, folder: str, committed: bool) -> None:
        if not committed:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        self._fs.delete(self._path(f"{self.root}/intents/{folder.split('/')[1]}"), False)

    def append(self, df: DataFrame, rows_per_shard: int = 20_000) -> int:
        """Writes an arrival as small shards, where its tasks run; returns the version that shows it."""
        merged_schema(self.manifest()[2], df.schema)  # a clash is refused before anything is written
        folder, committed = self._folder("arrival"), False
        try:
            df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(f"{self.root}/{folder}")
            new = self._written(folder)
            version = self._change(lambda live, said: (live + new, merged_schema(said, df.schema)))
            committed = True
        finally:
            self._done(folder, committed)
        return version

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.small, self.fan_in))) if size > self.small else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: per tier, the shards below half the target, if there are enough of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [sorted(t, key=lambda s: (-s.bytes, s.path)) for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]

    def _merge(self, run: list[Shard], schema: StructType, folder: str) -> list[Shard]:
        own = self.spark.newSession()  # its settings are not the caller's
        own.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.conf.set("spark.sql.files.minPartitionNum", "1")
        own.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        out = self._written(folder)
        if sum(s.rows for s in out) != sum(s.rows for s in run):
            raise RuntimeError("a merge changed the number of rows; nothing was committed")
        return out

    def compact(self) -> int:
        """Merges until no tier has a run that becomes fewer files; one commit a round. A run that does not is left as it is,
        and the others of its round go on. A round whose shards another writer has merged meanwhile is given up, and the
        next plans anew. Every commit leaves fewer shards, so the rounds end. Returns the version."""
        unpacked: set[frozenset[str]] = set()
        while True:
            version, live, schema = self.manifest()
            runs = [r for r in self.plan(live) if frozenset(s.path for s in r) not in unpacked]
            if not runs:
                return version
            folders, committed, new, gone = [self._folder("merge") for _ in runs], set(), [], set()
            try:
                for run, folder in zip(runs, folders):
                    out = self._merge(run, _schema(schema), folder)
                    if len(out) < len(run):
                        committed.add(folder)
                        new += out
                        gone |= {s.path for s in run}
                    else:
                        unpacked.add(frozenset(s.path for s in run))

                def change(now: list[Shard], said: str | None) -> tuple[list[Shard], str]:
                    if not gone <= {s.path for s in now}:
                        raise _Overtaken
                    return [s for s in now if s.path not in gone] + new, said

                if gone:
                    self._change(change)
            except _Overtaken:
                committed.clear()
            except BaseException:
                committed.clear()
                raise
            finally:
                for folder in folders:
                    self._done(folder, folder in committed)

    def vacuum(self, keep_versions: int = 1, stale_s: float = DAY) -> int:
        """Deletes shards that none of the newest manifests names and no writer is busy with; returns how many.

        Folders are listed first, then intents, then manifests: a folder without an intent has been committed or
        given up by then."""

        def listed(what: str) -> list:
            at = self._path(f"{self.root}/{what}")
            return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

        folders = [f.getPath() for f in listed("shards")]
        now, busy = time.time(), set()
        for f in listed("intents"):
            if now - f.getModificationTime() / 1000 < stale_s:
                busy.add(f.getPath().getName())
            else:
                self._fs.delete(f.getPath(), False)
        named = {s.path for v in self.versions()[-keep_versions:] for s in self.manifest(v)[1]}
        n = 0
        for folder in folders:
            if folder.getName() in busy or not self._fs.exists(folder):
                continue
            files = [f.getPath() for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
            dead = [f for f in files if f"shards/{folder.getName()}/{f.getName()}" not in named]
            n += len(dead)
            if len(dead) == len(files):
                self._fs.delete(folder, True)
            else:
                for f in dead:
                    self._fs.delete(f, False)
        return n

    def read(self, version: int | None = None) -> DataFrame:
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise FileNotFoundError(f"{self.root} has no manifest")
        if not shards:
            return self.spark.createDataFrame([], _schema(schema))
        return self.spark.read.schema(_schema(schema)).parquet(*[f"{self.root}/{s.path}" for s in shards])


class _Overtaken(Exception):
    """Another writer has merged the shards of this round."""


def _schema(said: str) -> StructType:
    return StructType.fromJson(json.loads(said))
