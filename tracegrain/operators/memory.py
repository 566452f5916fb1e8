"""Memory-snapshot analysis: devices, segments, blocks and allocation traces as DataFrames.

Column names are parameters, so the same code runs on snapshot tables and on any tables of that shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.operators.scans import scanned


def exact_sum(column: str | Column) -> Column:
    """Sum of doubles that hardly depends on the order of rows: exact in decimals of 8 places, and what those leave of each value as doubles.

    Values with up to 8 places leave nothing, so their sum is the same in any order. Values that a decimal cannot hold
    (1e30 or more, infinite, NaN) are summed apart; where the decimals' sum overflows, all values are summed as doubles.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    exact = value.try_cast("decimal(38,8)")
    none = F.lit(0.0)
    rest, large = F.sum(value - exact.cast("double")), F.sum(F.when(exact.isNull(), value))
    whole = F.try_sum(exact).cast("double")
    total = F.coalesce(whole, none) + F.coalesce(rest, none) + F.coalesce(large, none)
    return F.when(F.count(value) > 0, F.when((F.count(exact) > 0) & whole.isNull(), F.sum(value)).otherwise(total))


def percent(part: Column, whole: Column) -> Column:
    """part as a percentage of whole; null where whole is 0."""
    return part * 100.0 / F.nullif(whole, F.lit(0.0))


def on_device(df: DataFrame, device: str, only: object | None) -> DataFrame:
    """Optional equality filter; none where `only` is None."""
    return df if only is None else df.filter(F.col(device) == only)


def device_overview(segments: DataFrame, device: str, total: str, allocated: str, expandable: Column) -> DataFrame:
    """Total and allocated bytes, fragmentation, segments and expandable segments of each device."""
    sums = segments.groupBy(device).agg(exact_sum(total).alias("total_size"), exact_sum(allocated).alias("allocated_size"), F.count("*").alias("segment_count"), F.sum(expandable.cast("int")).alias("expandable_count"))
    return sums.withColumn("frag_pct", percent(F.col("total_size") - F.col("allocated_size"), F.col("total_size")))


def distribution(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Count, sum and mean size of each group: block states, segment types."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), exact_sum(size).alias("total_size")).withColumn("avg_size", F.col("total_size") / F.col("n"))


def fragmentation_detail(segments: DataFrame, key: list[str], total: str, allocated: str) -> DataFrame:
    """Waste and its share for each segment, to be ordered by waste."""
    return segments.select(*key, F.col(total).alias("total_size"), F.col(allocated).alias("allocated_size")).withColumn("waste", F.col("total_size") - F.col("allocated_size")).withColumn("frag_pct", percent(F.col("waste"), F.col("total_size")))


def top_by(rows: DataFrame, size: str, ties: list[str], n: int) -> DataFrame:
    """The n largest rows; ties in the order of the given columns."""
    return rows.orderBy(F.desc_nulls_last(size), *(F.asc_nulls_last(t) for t in ties)).limit(n)


def stack_attribution(blocks: DataFrame, stack: str, size: str, n: int = 10) -> DataFrame:
    """Bytes, blocks and share of the total of each stack; a missing stack is a group of its own."""
    total = blocks.agg(exact_sum(size).alias("all_size"))
    by = blocks.groupBy(stack).agg(exact_sum(size).alias("total_size"), F.count("*").alias("n"))
    shares = by.join(F.broadcast(total)).withColumn("pct", percent(F.col("total_size"), F.col("all_size"))).drop("all_size")  # the total is one row
    return top_by(shares, "total_size", [stack], n)


def running(traces: DataFrame, device: str, order: str, delta: Column) -> DataFrame:
    """Running sum of a signed change within each device and the number of its event, from 1; every event gives a row.

    A scan over blocks, so a device that holds much of all rows is many tasks.
    """
    return scanned(traces.withColumn("delta", delta), [device], [order], {"running": ("sum", F.col("delta"), True), "nth": ("count", F.lit(1), True)})


def peaks(run: DataFrame, device: str, order: str) -> DataFrame:
    """Largest running sum of each device, at least 0, with the first event that attains it (the first of all, if none is above 0).

    One aggregate without a sort: the best is the largest sum and, among equals, the earliest event.
    """
    best = F.max_by(F.struct(F.col(order).alias("at"), F.col("running").alias("peak")), F.struct(F.greatest("running", F.lit(0)), -F.col(order))).alias("x")
    return run.groupBy(device).agg(best).select(device, F.greatest(F.col("x.peak"), F.lit(0)).alias("peak"), F.col("x.at").alias("peak_at"))


def baselines(run: DataFrame, device: str, order: str) -> DataFrame:
    """Running sum after event max(1, n // 10) of each device; 0 if there are no more events than that."""
    cuts = run.groupBy(device).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("cut"))
    at = run.select(F.col(device).alias("_device"), F.col("nth"), "running")
    found = cuts.join(at, F.col(device).eqNullSafe(F.col("_device")) & (F.col("nth") == F.col("cut") + 1), "left")
    return found.select(device, F.coalesce("running", F.lit(0)).alias("baseline"))


def monotonic(run: DataFrame, device: str, order: str) -> DataFrame:
    """Whether a device's running value never falls and ends above its start; false with fewer than two events."""
    ends = run.groupBy(device).agg(F.count("*").alias("n"), F.bool_and((F.col("nth") == 1) | (F.col("delta") >= 0)).alias("never_falls"), F.min_by("running", order).alias("first"), F.max_by("running", order).alias("last"))
    return ends.select(device, "n", (F.col("never_falls") & (F.col("last") > F.col("first")) & (F.col("n") >= 2)).alias("monotonic"))


def before_failures(events: DataFrame, device: str, index: str, is_failure: Column, is_alloc: Column, size: str, span: int = 50, keep: int = 5) -> DataFrame:
    """For each failure, the largest allocations among the events of the `span` indexes before it.

    The range is joined on index blocks of `span`, so a failure meets two blocks and not the device's whole history.
    """
    block = lambda c: F.floor(F.col(c) / span)
    failures = events.filter(is_failure).select(F.col(device).alias("device"), F.col(index).alias("failed_at")).withColumn("block", F.explode(F.array(block("failed_at") - 1, block("failed_at"))))
    allocs = events.filter(is_alloc).select(F.col(device).alias("device"), F.col(index).alias("index"), F.col(size).alias("size"), block(index).alias("block"))
    near = failures.join(allocs, ["device", "block"]).filter("index between failed_at - {0} and failed_at".format(span))
    rank = F.row_number().over(Window.partitionBy("device", "failed_at").orderBy(F.desc("size"), "index"))
    return near.withColumn("r", rank).filter(F.col("r") <= keep).select(F.col("device").alias(device), "failed_at", "r", F.col("index").alias("alloc_at"), "size")


def long_lived(blocks: DataFrame, traces: DataFrame, keys: list[str], index: str, threshold: int) -> DataFrame:
    """Blocks whose address was first seen before the threshold. keys: address, and device to scope it."""
    first = traces.groupBy(*keys).agg(F.min(index).alias("first_seen")).filter(F.col("first_seen") < threshold)
    return blocks.join(first, keys)


def leak_risk(monotone: Column, long_lived_blocks: Column) -> Column:
    return F.when(monotone & (long_lived_blocks >= 5), "high").when(monotone | (long_lived_blocks >= 3), "medium").otherwise("low")


def health(frag_pct: Column, segments: Column, failed: Column) -> Column:
    """Health ladder of a device; a failure outranks all."""
    return F.when(failed | (frag_pct > 15), "critical").when((frag_pct > 5) | (segments > 100), "attention").otherwise("healthy")


def failure_cause(allocs: DataFrame, group: str, stack: str, size: str, free: str) -> DataFrame:
    """Cause of each failure from its last large allocations: needs three; one stack for all (none counts as one) before size."""
    prefix = F.coalesce(F.left(F.col(stack), F.lit(60)), F.lit(""))
    top = allocs.groupBy(group, prefix.alias("stack")).agg(F.count("*").alias("n"), exact_sum(size).alias("s"), F.max(F.coalesce(free, F.lit(0))).alias("free"))
    per = top.groupBy(group).agg(F.sum("n").alias("n"), F.max("n").alias("same"), exact_sum("s").alias("total"), F.max("free").alias("free"))
    cause = F.when(F.col("n") < 3, "insufficient").when(F.col("same") >= 3, "same_stack").when(F.col("total") > 3 * F.col("free"), "burst").otherwise("single_large")
    return per.select(group, "n", "total", cause.alias("cause"))


def new_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    return after.join(before, key, "left_anti")


def grown(before: DataFrame, after: DataFrame, key: str, size: str) -> DataFrame:
    """Rows of both snapshots that are larger in the second."""
    old = before.select(key, F.col(size).alias("old_size"))
    return after.select(key, F.col(size).alias("new_size")).join(old, key).filter("new_size > old_size").withColumn("growth", F.col("new_size") - F.col("old_size"))
