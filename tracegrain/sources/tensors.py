"""Tensors of a sharded checkpoint as a Spark data source: names, shapes and types from file headers, without the data."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

INDEX = "model.safetensors.index.json"
SCHEMA = "tensor_name string, shape string, dtype string, file string"
#: Types in a header, and what they are called.
TYPES = {
    "BOOL": "torch.bool", "U8": "torch.uint8", "I8": "torch.int8", "I16": "torch.int16", "I32": "torch.int32", "I64": "torch.int64", "F16": "torch.float16", "BF16": "torch.bfloat16",
    "F32": "torch.float32", "F64": "torch.float64", "F8_E4M3": "torch.float8_e4m3fn", "F8_E5M2": "torch.float8_e5m2",
}
TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


class Shard(InputPartition):
    def __init__(self, file: str, names: list[str]):
        self.file, self.names = file, names


def header(path: str) -> dict:
    """Names to type, shape and place: the JSON behind the length that a file begins with."""
    with open(path, "rb") as file:
        (length,) = struct.unpack("<Q", file.read(8))
        return json.loads(file.read(length))


class TensorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests on names and files choose the files to open; Spark tests the rows again."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("tensor_name",), ("file",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f

    def partitions(self) -> list[Shard]:
        with open(os.path.join(self.path, INDEX), encoding="utf-8") as file:
            where = json.load(file).get("weight_map", {})
        shards: dict[str, list[str]] = {}
        for name, file in where.items():
            row = {"tensor_name": name, "file": file}
            if all(TESTS[kind](row[column], value) for column, kind, value in self.tests):
                shards.setdefault(file, []).append(name)
        return [Shard(file, sorted(names)) for file, names in sorted(shards.items())]

    def read(self, partition: Shard) -> Iterator[tuple]:
        held = header(os.path.join(self.path, partition.file))
        for name in partition.names:
            found = held.get(name)
            yield (name, str(tuple(found["shape"])), TYPES.get(found["dtype"], found["dtype"]), partition.file) if found else (name, "N/A", "N/A", partition.file)


class TensorSource(DataSource):
    """spark.read.format("tensor_index").option("path", folder).load(), a task for each file. The folder must be where all tasks can read it."""

    @classmethod
    def name(cls) -> str:
        return "tensor_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options["path"])


def read(spark: SparkSession, path: str, pattern: str = "*", limit: int = 0) -> DataFrame:
    """Tensors whose name matches the glob, by file and name; the first `limit`, if that is above 0."""
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("tensor_index").option("path", path).load()
    fixed = pattern.split("*")[0].split("?")[0].split("[")[0]
    if fixed:
        rows = rows.filter(F.col("tensor_name").startswith(fixed))
    rows = rows.filter(F.col("tensor_name").rlike(re.sub(r"\\Z$", r"\\z", fnmatch.translate(pattern)))).orderBy("file", "tensor_name")
    return rows.limit(limit) if limit > 0 else rows
