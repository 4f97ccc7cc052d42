"""Paginated REST searches as a Python data source, and small files of settings."""

from __future__ import annotations

import io
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def paginated(fetch: Callable[[str | None], tuple[list[tuple], str | None]], limit: int, spacing: float = 0.25) -> Iterator[tuple]:  # S15, O07
    """Rows of all pages up to ``limit``: fetch(cursor) gives a page's rows and the next cursor."""
    cursor, n = None, 0
    while True:
        rows, cursor = fetch(cursor)
        for row in rows:
            if n >= limit:
                return
            n += 1
            yield row
        if cursor is None or not rows:
            return
        time.sleep(spacing)


def rest_source(name: str, schema: str, fetch: Callable[[str, str | None], tuple[list[tuple], str | None]], queries: list[str], limit: int, spacing: float = 0.25) -> type[DataSource]:  # S15
    """A data source that reads each query's pages in a task of its own; register it and use its name as a format."""

    class Partition(InputPartition):
        pass

    class Reader(DataSourceReader):
        def partitions(self):
            return [Partition(q) for q in queries]

        def read(self, partition):
            return paginated(lambda cursor: fetch(partition.value, cursor), limit, spacing)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)


def settings(path: str) -> dict:  # S19
    """The mappings of a settings file, nested by indentation; ``- value`` lines make lists. Values are text. Empty if
    the file cannot be read."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        bare = [re.sub(r"(^|\s)#.*", "", line.rstrip("\n")) for line in f]
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in bare if x.strip()]
    plain = lambda v: v.strip().strip("\"'")

    def block(i: int, indent: int) -> tuple[dict | list, int]:
        """What stands at this indentation from line i on, and the line after it."""
        if lines[i][1].startswith("- "):
            items = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                items.append(plain(lines[i][1][2:]))
                i += 1
            return items, i
        out: dict = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            key, sep, value = lines[i][1].partition(":")
            i += 1
            if not sep:
                continue
            nested = i < len(lines) and not value.strip() and (lines[i][0] > indent or (lines[i][0] == indent and lines[i][1].startswith("- ")))
            if nested:
                out[key.strip()], i = block(i, lines[i][0])
            else:
                out[key.strip()] = plain(value) if value.strip() else None
        return out, i

    top: dict = {}
    i = 0
    while i < len(lines):
        got, i = block(i, lines[i][0])
        top |= got if isinstance(got, dict) else {}
    return top


def fetch_archive(url: str, folder: str, fetch: Callable[[str], bytes], members: tuple[str, ...] = (), tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[str]:  # S04, V05
    """The files of a ZIP archive that ``fetch`` gets, extracted below ``folder``: tried three times with waits of 1, 2, ...
    seconds. Members that must be there are checked, and none may lead out of the folder, before anything is written."""
    for n in range(tries):
        try:
            archive = zipfile.ZipFile(io.BytesIO(fetch(url)))
            break
        except (OSError, zipfile.BadZipFile):
            if n == tries - 1:
                raise
            sleep(2.0**n)
    names = [i.filename for i in archive.infolist() if not i.is_dir()]
    missing = [m for m in members if m not in names]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    root = os.path.realpath(folder)
    if any(os.path.commonpath([root, os.path.realpath(os.path.join(root, n))]) != root for n in names):
        raise ValueError("a member leads out of the folder")
    archive.extractall(root)
    return [os.path.join(root, n) for n in names]
