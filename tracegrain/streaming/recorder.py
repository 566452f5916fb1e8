"""An append-only record of a stream with an index that grows by one for each event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.operators import scans


def recorder(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: events of each batch are appended to path as Parquet, with `index` (from 0) in the given order.

    Batches stand in folders of their own number, and indexes go on from the batches before, so a batch that is run again after a
    failure replaces what it had written and gives the same indexes. The order should tell rows apart. Indexes are handed out by
    ranges of the order: a batch is never sorted in one task.
    """

    def record(batch: DataFrame, number: int) -> None:
        rows = scans.scanned(batch, [], order, {"_before": ("count", F.lit(1), False)})
        first = next_index(batch.sparkSession, path, number)
        out = rows.withColumn("index", F.coalesce("_before", F.lit(0)) + F.lit(first)).select("index", *batch.columns)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return record


def next_index(spark, path: str, batch: int) -> int:
    """One above the greatest index of the batches before this one; only their folders are read, for the index alone."""
    try:
        known = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return known.filter(F.col("batch") < batch).agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
