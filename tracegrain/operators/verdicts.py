"""Verdicts on memory snapshots: peaks with their contributors, fragmentation, leaks and comparison of two snapshots.

They put the operators of `memory` together; each returns rows, with the figures that a verdict rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions import textual
from tracegrain.operators import memory
from tracegrain.operators.memory import exact_sum


def status(value: Column, attention: float, critical: float) -> Column:
    return F.when(value > critical, "critical").when(value > attention, "attention").otherwise("healthy")


def peak(run: DataFrame, device: str, order: str) -> DataFrame:
    """Peak, baseline and growth of each device; growth in percent is null without a positive baseline."""
    both = memory.peaks(run, device, order).join(memory.baselines(run, device, order), device)
    growth = F.col("peak") - F.col("baseline")
    return both.withColumn("growth", growth).withColumn("growth_pct", F.when(F.col("baseline") > 0, growth * 100.0 / F.nullif("baseline", F.lit(0))))


def contributors(rows: DataFrame, device: str, size: str, tie: str, n: int = 10) -> DataFrame:
    """The n largest allocations of each device, with their place."""
    place = F.row_number().over(Window.partitionBy(device).orderBy(F.desc(size), tie))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def fragmentation(segments: DataFrame, blocks: DataFrame, total: str, allocated: str, size: str, pending: Column) -> DataFrame:
    """One row: share of reserved bytes that is free, and how much of that only waits to be freed (above half: pseudo).

    The totals are of all devices, whatever the details are narrowed to. Shares are rounded to one place before they are judged.
    """
    whole = segments.agg(exact_sum(total).alias("reserved"), exact_sum(allocated).alias("allocated"))
    waits = blocks.filter(pending).agg(F.coalesce(exact_sum(size), F.lit(0.0)).alias("pending"))
    x = whole.crossJoin(waits).withColumn("free", F.col("reserved") - F.col("allocated"))  # both are one row
    x = x.withColumn("frag_pct", F.when(F.col("reserved") > 0, textual.half_even(F.col("free") / F.nullif("reserved", F.lit(0.0)) * 100, 1)).otherwise(0.0))
    x = x.withColumn("pending_pct", F.when(F.col("free") > 0, textual.half_even(F.col("pending") / F.nullif("free", F.lit(0.0)) * 100, 1)).otherwise(0.0))
    return x.withColumn("status", status(F.col("frag_pct"), 5, 15)).withColumn("pseudo", F.col("pending_pct") > 50)


def leaks(run: DataFrame, long_lived: DataFrame, device: str, order: str) -> DataFrame:
    """Leak risk of each device from the trend of its running value and its number of long-lived blocks."""
    counts = long_lived.groupBy(device).agg(F.count("*").alias("long_lived"))
    x = memory.monotonic(run, device, order).join(counts, device, "left").na.fill(0, ["long_lived"])
    return x.withColumn("risk", memory.leak_risk(F.col("monotonic"), F.col("long_lived")))


def snapshots_compared(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each metric of two one-row tables: both values, their difference and its sign."""
    a = before.unpivot([], metrics, "metric", "before")
    b = after.unpivot([], metrics, "metric", "after")
    diff = F.col("after") - F.col("before")
    return a.join(b, "metric").withColumn("diff", diff).withColumn("trend", F.when(diff > 0, "[+]").when(diff < 0, "[-]").otherwise("[=]"))
