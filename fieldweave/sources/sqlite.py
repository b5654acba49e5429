"""Tables of a database file as a Spark source: filters go to the database, ranges of row numbers are partitions.

The file lies where driver and executors can open it, such as a shared mount; it is only read.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _term(f: Filter) -> tuple[str, list] | None:
    """A filter as a condition and its values; None for what Spark keeps to itself."""
    name = getattr(f, "attribute", None)
    if not name or len(name) != 1:
        return None
    column = _quoted(name[0])
    if isinstance(f, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    if not all(isinstance(v, int | float | str) or v is None for v in values):
        return None
    if isinstance(f, In):
        return f"{column} IN ({', '.join('?' * len(values))})", values
    if type(f) in _COMPARED:
        return f"{column} {_COMPARED[type(f)]} ?", values
    return None


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "4"))
        self.names = schema.names
        self.terms: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (term := _term(f)) is None:
                yield f
            else:
                self.terms.append(term)

    def partitions(self) -> Sequence[InputPartition]:
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(t for t, _ in self.terms)])
        values = [partition.first, partition.last, *(v for _, more in self.terms for v in more)]
        db = _opened(self.path)
        try:
            yield from db.execute(f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.table)} WHERE {where}", values)
        finally:
            db.close()


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give the schema: a column of a database file has no type of its own")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    """A table, or those of its columns that schema names: only they are read. Filters on them are the database's where it can, ranges of rows are tasks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).option("partitions", partitions).load()
