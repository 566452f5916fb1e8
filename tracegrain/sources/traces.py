"""Trace-event files as a Spark data source: one JSON array of events, read by byte ranges that resynchronise at event borders."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "name string, cat string, ph string, pid string, tid string, ts double, dur double, id string, args string"
#: Where an event may begin: a brace behind a bracket or comma.
BORDER = re.compile(rb"[\[,]\s*(?=\{)")
CHUNK = 1 << 20


class Bytes(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


class _Window:
    """A file from a place on, read as far as it is needed; what lies behind is let go."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        new = self.file.read(CHUNK)
        self.data += new
        return bool(new)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _event(window: _Window) -> tuple[dict | None, int] | None:
    """The object that the window begins with, and its length; (None, 0) if there is none, None at the end of the file."""
    size = CHUNK
    while True:
        piece = window.data[:size]
        text = piece.decode("utf-8", "ignore")
        try:
            found, stop = json.JSONDecoder().raw_decode(text)
            return found, len(text[:stop].encode())
        except json.JSONDecodeError as e:
            # an error within the text, not at its end, is no event; an open string or object goes on
            if e.pos < len(text) - 1 and not e.msg.startswith("Unterminated"):
                return None, 0
            if size < len(window.data):
                size *= 2
            elif not window.more():
                return None
            else:
                size = len(window.data)


def events(path: str, low: int, high: int) -> Iterator[dict]:
    """Events whose first byte lies in [low, high).

    An event is an object with a phase ("ph") behind a bracket or comma. Quotes within strings are escaped, so none is found
    there. Objects within arguments begin behind a comma only within arrays, and are no events without a phase.
    """
    with open(path, "rb") as file:
        window = _Window(file, max(low - 64, 0))
        synced = False
        while True:
            m = BORDER.search(window.data)
            if m is None:
                window.skip(max(len(window.data) - 64, 0))
                if not window.more():
                    return
                continue
            window.skip(m.end())
            if window.at >= high:
                return
            found = _event(window)
            if found is None:
                return
            event, length = found
            if isinstance(event, dict) and "ph" in event and window.at >= low:
                yield event
                synced = True
            # before the first event, an object that is none may be part of one that began in the range before
            window.skip(length if length and (synced or window.at < low and isinstance(event, dict) and "ph" in event) else 1)


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tasks = options["path"], int(options.get("numPartitions", "8"))

    def partitions(self) -> list[Bytes]:
        size = os.path.getsize(self.path)
        step = max(1, -(-size // self.tasks))
        return [Bytes(a, min(a + step, size)) for a in range(0, size, step)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        for e in events(self.path, partition.low, partition.high):
            yield (_text(e.get("name")), _text(e.get("cat")), _text(e.get("ph")), _text(e.get("pid")), _text(e.get("tid")), _number(e.get("ts")), _number(e.get("dur")), _text(e.get("id")), _text(e.get("args")))


class TraceSource(DataSource):
    """spark.read.format("trace_events").option("path", file).load(). The file must be where all tasks can read it."""

    @classmethod
    def name(cls) -> str:
        return "trace_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(dict(self.options))


def read(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(TraceSource)
    return spark.read.format("trace_events").options(path=path, numPartitions=str(partitions)).load()


def slices(trace: DataFrame) -> DataFrame:
    """Complete events: pid, tid, name, start and end in microseconds, args."""
    return trace.filter("ph = 'X'").select("pid", "tid", "name", F.col("ts").alias("start"), (F.col("ts") + F.coalesce("dur", F.lit(0.0))).alias("end"), "args")


def flow_ends(trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts and ends of flows: flow (category and id), name, pid, tid, at."""
    side = lambda ph: trace.filter(F.col("ph") == ph).select(F.concat_ws(":", F.coalesce("cat", F.lit("")), "id").alias("flow"), "name", "pid", "tid", F.col("ts").alias("at"))
    return side("s"), side("f")


def process_names(trace: DataFrame) -> DataFrame:
    """Names of processes from metadata events: pid, process."""
    named = trace.filter("ph = 'M' and name = 'process_name'")
    return named.groupBy("pid").agg(F.max(F.get_json_object("args", "$.name")).alias("process"))
