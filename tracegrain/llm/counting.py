"""Sums of long count vectors over all tasks, as Spark rows of packed vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
#: Rows of a block that one task sums at a time, on the first two levels.
TOGETHER = 64


def packed(counts: np.ndarray) -> bytes:
    """Counts in 1, 2, 4 or 8 bytes each, as few as the largest needs, after that width."""
    largest = int(counts.max(initial=0))
    width = next((w for w in (1, 2, 4) if largest < 1 << (8 * w)), 8)
    return bytes([width]) + counts.astype(KINDS[width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, KINDS[data[0]], offset=1).astype(np.int64)


def _summed(table: pa.Table) -> pa.Table:
    total = None
    for data in table.column("counts"):
        own = unpacked(data.as_py())
        total = own if total is None else total + own
    return pa.table([table.column("block")[:1].cast(pa.int32()), table.column("part")[:1].cast(pa.int32()), pa.array([packed(total)], pa.binary())], ["block", "part", "counts"])


def summed(parts: DataFrame) -> DataFrame:
    """parts (block int, counts binary) to one row for each block.

    Three levels: 64 tasks' rows of a block, 64 of those sums, and the rest, so no task meets all rows of a block.
    """
    rows = parts.withColumn("part", F.spark_partition_id())
    for _ in range(2):
        rows = rows.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("int")).groupBy("block", "part").applyInArrow(_summed, "block int, part int, counts binary")
    return rows.groupBy("block").applyInArrow(_summed, "block int, part int, counts binary").select("block", "counts")


def batch(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([packed(c) for c in blocks.values()], pa.binary())], ["block", "counts"])
