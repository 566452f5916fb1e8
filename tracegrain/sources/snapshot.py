"""Pickled memory snapshots, shredded into segment, block, trace and stack tables."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<address:bigint,size:bigint,requested_size:bigint,state:string,frames:array<string>>"
SEGMENT = f"struct<device:int,address:bigint,total_size:bigint,allocated_size:bigint,active_size:bigint,requested_size:bigint,stream:bigint,segment_type:string,pool_id:array<bigint>,is_expandable:boolean,frames:array<string>,blocks:array<{BLOCK}>>"
TRACE = "struct<action:string,addr:bigint,device_free:bigint,size:bigint,stream:bigint,frames:array<string>>"


class _Plain(pickle.Unpickler):
    """Plain containers and numbers only: no class or function can be loaded."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a snapshot")


def _frames(value) -> list[str]:
    return [str(f) for f in value] if isinstance(value, (list, tuple)) else []


def _number(item: dict, *names: str, default: int | None = 0) -> int | None:
    return next((int(item[n]) for n in names if item.get(n) is not None), default)


def parsed(data: bytes) -> tuple[list, list]:
    """Segments and traces by device, with the defaults of missing keys; items that are no dicts are skipped."""
    found = _Plain(io.BytesIO(data)).load()
    if isinstance(found, list):
        found = {"segments": found}
    if not isinstance(found, dict):
        raise ValueError("a snapshot is a dict or a list")
    dicts = lambda items: [x for x in items or [] if isinstance(x, dict)]
    segments = [
        (
            _number(s, "device"), _number(s, "address"), _number(s, "total_size"), _number(s, "allocated_size"), _number(s, "active_size"), _number(s, "requested_size"), _number(s, "stream"), str(s.get("segment_type", "unknown")),
            [int(x) for x in s.get("segment_pool_id") or ()], bool(s.get("is_expandable", False)), _frames(s.get("frames")),
            [(_number(b, "address"), _number(b, "size"), _number(b, "requested_size"), str(b.get("state", "unknown")), _frames(b.get("frames"))) for b in dicts(s.get("blocks"))],
        )
        for s in dicts(found.get("segments"))
    ]
    traces = [[(str(t.get("action", "unknown")), _number(t, "addr"), _number(t, "device_free", default=None), _number(t, "size"), _number(t, "stream"), _frames(t.get("frames"))) for t in dicts(of)] for of in found.get("device_traces") or []]
    return segments, traces


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """segments, blocks, traces and stacks of the snapshot files under a path; each file is a task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(p, *parsed(bytes(c))) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": [r[0] for r in rows], "segments": [[_named(s, SEGMENT_NAMES) for s in r[1]] for r in rows], "traces": [[[_named(t, TRACE_NAMES) for t in of] for of in r[2]] for r in rows]})

    raw = files.mapInPandas(run, f"path string, segments array<{SEGMENT}>, traces array<array<{TRACE}>>")
    stack = F.when(F.size("frames") > 0, F.md5(F.to_json("frames")))
    segments = raw.select("path", F.posexplode("segments").alias("segment", "s")).select("path", "segment", "s.*").withColumn("stack", stack)
    blocks = segments.select("path", "segment", F.col("device"), F.posexplode("blocks").alias("block", "b")).select("path", "segment", "device", "block", "b.*").withColumn("stack", stack)
    traces = raw.select("path", F.posexplode("traces").alias("device", "of")).select("path", "device", F.posexplode("of").alias("trace_index", "t")).select("path", "device", "trace_index", "t.*").withColumn("stack", stack)
    stacks = segments.select("stack", "frames").unionByName(blocks.select("stack", "frames")).unionByName(traces.select("stack", "frames")).filter("stack is not null").dropDuplicates(["stack"])
    return {"segments": segments.drop("blocks", "frames"), "blocks": blocks.drop("frames"), "traces": traces.drop("frames"), "stacks": stacks}


SEGMENT_NAMES = ("device", "address", "total_size", "allocated_size", "active_size", "requested_size", "stream", "segment_type", "pool_id", "is_expandable", "frames", "blocks")
BLOCK_NAMES = ("address", "size", "requested_size", "state", "frames")
TRACE_NAMES = ("action", "addr", "device_free", "size", "stream", "frames")


def _named(values: tuple, names: tuple[str, ...]) -> dict:
    out = dict(zip(names, values, strict=True))
    if "blocks" in out:
        out["blocks"] = [dict(zip(BLOCK_NAMES, b, strict=True)) for b in out["blocks"]]
    return out
