"""A read-only Spark data source over SQLite files, for profiling exports of phone apps.

``spark.dataSource.register(SqliteSource)``, then
``spark.read.format("sqlite").option("path", file).option("table", name).load()``. The file must be
readable where tasks run. Row-id ranges are partitions. SQLite types values, not columns, so every
column is read as text beside a column ``<name>_type`` if ``types`` is set.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def connect(path: str) -> sqlite3.Connection:
    """Read-only, and without a look at the write-ahead log of an app that may be writing."""
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def tables(path: str) -> list[tuple[str, int]]:
    """Names and row counts of a file's tables."""
    con = connect(path)
    try:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return [(n, con.execute(f'SELECT count(*) FROM "{n}"').fetchone()[0]) for n in names]
    finally:
        con.close()


def columns(path: str, table: str) -> list[str]:
    con = connect(path)
    try:
        return [r[1] for r in con.execute(f'PRAGMA table_info("{table}")')]
    finally:
        con.close()


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.types = options["path"], options["table"], options.get("types", "false") == "true"
        self.n = int(options.get("numpartitions", options.get("numPartitions", "4")))

    def partitions(self) -> list[Range]:
        con = connect(self.path)
        try:
            first, last = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        finally:
            con.close()
        if first is None:
            return [Range(0, -1)]
        step = max(1, -(-(last - first + 1) // self.n))
        return [Range(a, min(a + step - 1, last)) for a in range(first, last + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        con = connect(self.path)
        try:
            names = [r[1] for r in con.execute(f'PRAGMA table_info("{self.table}")')]
            wanted = [f'CASE typeof("{c}") WHEN \'blob\' THEN hex("{c}") ELSE CAST("{c}" AS TEXT) END' for c in names]
            if self.types:
                wanted += [f'typeof("{c}")' for c in names]
            yield from con.execute(f'SELECT {", ".join(wanted)} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.first, partition.last))
        finally:
            con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        names = columns(self.options["path"], self.options["table"])
        more = [f"{c}_type" for c in names] if self.options.get("types", "false") == "true" else []
        return StructType([StructField(c, StringType()) for c in [*names, *more]])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options))
