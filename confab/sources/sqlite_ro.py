"""Read-only SQLite tables as a batch data source, split by ranges of an integer key.

``spark.read.format("sqlite_ro").schema(s).option("path", p).option("table", t)``. Options: ``key`` (integer
column to split on, default ``rowid``) and ``numPartitions`` (default 8). Only the columns of the declared schema
are selected, so a projection is stated by a narrower schema and a blob column nobody asked for is never read. SQLite files are
local: on a cluster the file has to be visible to every worker, or be landed as Parquet first.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class KeyRange(InputPartition):
    """Rows whose key is at least ``low`` and below ``high``."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        for needed in ("path", "table"):
            if not options.get(needed):
                raise ValueError(f"sqlite_ro: option '{needed}' is required")
        self.path, self.table = options["path"], _quoted(options["table"])
        self.key = _quoted(options.get("key", "rowid"))
        self.parts = max(1, int(options.get("numpartitions", options.get("numPartitions", "8"))))
        self.columns = ", ".join(_quoted(f.name) for f in schema.fields)
        self.where: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of a top-level column run in SQLite, with the values bound.

        Spark applies them again, since a column's values needn't have the declared type there; what matters is that the rows
        they drop never cross into Python. A boolean or an empty list stays with Spark alone.
        """
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else ()
            if values and len(f.attribute) == 1 and all(isinstance(v, int | float | str) and not isinstance(v, bool) for v in values):
                self.where.append((f"{_quoted(f.attribute[0])} IN ({', '.join('?' * len(values))})", values))
            yield f

    def partitions(self) -> list[KeyRange]:
        conn = _connect(self.path)
        try:
            low, high = conn.execute(f"SELECT min({self.key}), max({self.key}) FROM {self.table}").fetchone()
        finally:
            conn.close()
        if low is None:
            return [KeyRange(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [KeyRange(at, at + step) for at in range(low, high + 1, step)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        conn = _connect(self.path)
        try:
            more = "".join(f" AND {condition}" for condition, _ in self.where)
            yield from conn.execute(
                f"SELECT {self.columns} FROM {self.table} WHERE {self.key} >= ? AND {self.key} < ?{more}",
                (partition.low, partition.high, *(v for _, values in self.where for v in values)),
            )
        finally:
            conn.close()


class SqliteReadOnly(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        raise ValueError("sqlite_ro: declare a schema; SQLite columns have no fixed type")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Also lets Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteReadOnly)
