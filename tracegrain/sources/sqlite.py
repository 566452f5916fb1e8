"""SQLite tables as a Spark data source, read by ranges of rowid so that each range is a task."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _type(declared: str):
    """Spark type of a column by SQLite's affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if "CHAR" in d or "CLOB" in d or "TEXT" in d or not d:
        return StringType()
    return BinaryType() if "BLOB" in d else DoubleType()


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.tasks = int(options.get("numPartitions", "8"))

    def partitions(self) -> list[Range]:
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.tasks)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        turn = [{"bigint": lambda v: int(v), "double": lambda v: float(v), "string": lambda v: v if isinstance(v, str) else str(v)}.get(f.dataType.simpleString(), lambda v: v) for f in self.schema.fields]
        with _open(self.path) as db:
            for row in db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                yield tuple(None if v is None else t(v) for t, v in zip(turn, row, strict=True))


class SqliteSource(DataSource):
    """spark.read.format("sqlite_table").option("path", file).option("table", name).load(). The file must be where all tasks can read it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(c[1], _type(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


def tables(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


def read(spark, path: str, table: str, partitions: int = 8):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, numPartitions=str(partitions)).load()
