"""Files that a job writes for itself in the cluster's shared folder, and names put in place once."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Filesystems whose rename refuses an existing target in one step.
RENAMES_ONCE = ("hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs")
_own: str | None = None
_folders: list[str] = []
_tables: list[str] = []


def folder(spark: SparkSession, what: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary
    folder of its own; on a cluster the setting is required, as executors share no other place."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise LookupError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, _own, True)
        base = _own
    path = f"{base.rstrip('/')}/siltstone/{what}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def made_table(name: str) -> None:
    """Notes a catalog table over such a folder."""
    _tables.append(name)


def clean(spark: SparkSession) -> int:
    """Removes all folders and tables that this driver has made, once no result needs them any more: a result is read
    from them until it is written. Returns how many folders went."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    gone = 0
    while _folders:
        path = _folders.pop()
        fs, make = filesystem(spark, path)
        gone += bool(fs.delete(make(path), True))
    return gone


def drop(spark: SparkSession, path: str) -> None:
    """Removes one folder that this driver has made and no result reads any more."""
    fs, make = filesystem(spark, path)
    fs.delete(make(path), True)
    if path in _folders:
        _folders.remove(path)


def settled(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and what depends on partitions is fixed."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, columns: list[str], what: str, dealt: bool = False, n: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``columns``: joins and groups by them read it in place. n: how many
    buckets, ``buckets_of`` them if not given. dealt: the rows are already dealt by ``columns`` to n partitions, so they need
    not travel to lie in few files."""
    spark = df.sparkSession
    name, n = f"siltstone_{uuid.uuid4().hex}", n or buckets_of(spark)
    (df if dealt else df.repartition(n, *columns)).write.bucketBy(n, *columns).sortBy(*columns).option("path", folder(spark, what)).saveAsTable(name)
    made_table(name)
    return spark.table(name)


def filesystem(spark: SparkSession, path: str):
    """The path's filesystem, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def put(fs, path, text: str) -> None:
    out = fs.create(path)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def place_once(fs, draft, final) -> bool:
    """Puts the file ``draft`` under the name ``final``; False if that exists. Never replaces it: a hard link on local
    files, else a rename that refuses an existing target; other filesystems are refused."""
    scheme = fs.getUri().getScheme()
    if scheme == "file":
        try:
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        except FileExistsError:
            return False
        return True
    if scheme not in RENAMES_ONCE:
        raise NotImplementedError(f"{scheme}: its rename does not refuse an existing file, so writers could undo each other")
    try:
        return bool(fs.rename(draft, final))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
