"""Tables of a database as a partitioned data source, over any DB-API connection.

Each task reads a range of the key over a connection of its own, fetching some rows at a time. Filters that Spark pushes down
become conditions of the statement, with their values as parameters; those that the database cannot say are left to
Spark. Ranges are cut evenly between the least and the greatest key, which one statement tells; the rows with a null key are
read by the first task.

The session's setting ``spark.sql.python.filterPushdown.enabled`` switches the pushing down on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FETCH = 10_000
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(f: Filter) -> tuple[str, list] | None:
    """A pushed filter as a condition and its parameters; None if it is left to Spark. Texts are compared by ``instr`` and
    ``substr``, as LIKE would ignore case in some databases and has wildcards of its own."""
    if isinstance(f, Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1:
        return None
    c = quoted(f.attribute[0])
    for kind, op in _COMPARED.items():
        if type(f) is kind:
            return f"{c} {op} ?", [f.value]
    if isinstance(f, EqualNullSafe):
        return (f"{c} IS NULL", []) if f.value is None else (f"({c} IS NOT NULL AND {c} = ?)", [f.value])
    if isinstance(f, In):
        return f"{c} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{c} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    if isinstance(f, StringContains):
        return f"instr({c}, ?) > 0", [f.value]
    if isinstance(f, StringStartsWith):
        return f"substr({c}, 1, {len(f.value)}) = ?", [f.value]
    if isinstance(f, StringEndsWith) and f.value:
        return f"substr({c}, {-len(f.value)}) = ?", [f.value]
    return None


class Range(InputPartition):
    def __init__(self, low, high, nulls: bool):
        self.low, self.high, self.nulls = low, high, nulls


class Reader(DataSourceReader):
    def __init__(self, connect: Callable, table: str, key: str, tasks: int, schema: StructType):
        self.connect, self.table, self.key, self.tasks, self.schema = connect, table, key, tasks, schema
        self.tests: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            said = condition(f)
            if said is None:
                yield f
            else:
                self.tests.append(said[0])
                self.values += said[1]

    def _statement(self, columns: str, *tests: str) -> str:
        where = " AND ".join([*self.tests, *tests])
        return f"SELECT {columns} FROM {quoted(self.table)}" + (f" WHERE {where}" if where else "")

    def partitions(self) -> list[Range]:
        k = quoted(self.key)
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(self._statement(f"min({k}), max({k})"), self.values)
            low, high = cursor.fetchone()
        finally:
            connection.close()
        if low is None:
            return [Range(None, None, True)]
        step = max(1, -(-(high - low + 1) // self.tasks))
        return [Range(a, a + step, a == low) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        k, own = quoted(self.key), []
        if partition.low is None:
            test = f"{k} IS NULL"
        else:
            test, own = f"({k} >= ? AND {k} < ?{f' OR {k} IS NULL' if partition.nulls else ''})", [partition.low, partition.high]
        schema = to_arrow_schema(self.schema)
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(self._statement(", ".join(map(quoted, self.schema.names)), test), [*self.values, *own])
            while rows := cursor.fetchmany(FETCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            connection.close()


def source(name: str, connect: Callable, schema: str, table: str, key: str, tasks: int = 8) -> type[DataSource]:  # S16
    """A data source over one table with an integer key. connect: makes a DB-API connection, on any executor."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> Reader:
            return Reader(connect, table, key, tasks, schema)

    return Source


def scan(spark: SparkSession, connect: Callable, schema: str, table: str, key: str, tasks: int = 8) -> DataFrame:  # S16
    """The table's rows, read range by range when they are asked for."""
    name = f"siltstone_{table}"
    spark.dataSource.register(source(name, connect, schema, table, key, tasks))
    return spark.read.format(name).load()
