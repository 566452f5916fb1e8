"""Steps and ranks: time metrics of a step, rows of stages, comparisons, top collectives, marks, time split and outliers.

Sweeps over starts and ends are scans over blocks, so a step or rank of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.operators.cluster import summary, swept
from tracegrain.operators.memory import exact_sum

COMPUTE, COMMUNICATE, COPY = "computation", "communication", "memory"


def step_metrics(rows: DataFrame, keys: list[str], start: str, end: str, kind: str, receive: Column, wait: str, launched: str) -> DataFrame:
    """Time metrics of each (rank, step) from the intervals of its tasks, by one sweep over starts and ends.

    kind is computation, communication, memory or anything else, which only stretches the step. Times are as in the
    input, as long integers. stage is what is not receiving, bubble is receiving; preparing and tail lie before the first
    and behind the last computation or communication. A metric without rows is 0, the mean launch delay null.
    """
    flags = {"c": F.col(kind) == COMPUTE, "m": F.col(kind) == COMMUNICATE, "y": F.col(kind) == COPY, "r": (F.col(kind) == COMMUNICATE) & receive}
    pieces = swept(rows, keys, start, end, flags)
    time = lambda c: F.coalesce(F.sum(F.when(c, F.col("piece"))), F.lit(0))
    c, m, y, r = (F.coalesce(F.col(k) > 0, F.lit(False)) for k in flags)
    times = pieces.groupBy(*keys).agg(
        time(c).alias("computation"), time(m & ~c).alias("communication_not_overlapped"), time(m & c).alias("overlapped"), time(m).alias("communication"), time(~c & ~m & ~y).alias("free"),
        time(y).alias("memory"), time(y & ~c & ~m).alias("memory_not_overlapped"), time(r).alias("bubble"), time(m & ~c & ~r).alias("communication_without_receive"),
    )
    device = F.col(kind).isin(COMPUTE, COMMUNICATE)
    own = rows.groupBy(*keys).agg(
        (F.max(end) - F.min(start)).alias("step_time"), (F.min(F.when(device, F.col(start))) - F.min(start)).alias("preparing"), (F.max(end) - F.max(F.when(device, F.col(end)))).alias("tail"),
        F.coalesce(F.sum(F.when(F.col(kind) == COMMUNICATE, F.col(wait))), F.lit(0)).alias("wait"), F.coalesce(F.sum(F.when(F.col(kind) == COMMUNICATE, F.col(end) - F.col(start) - F.col(wait))), F.lit(0)).alias("transmit"),
        F.avg(F.col(start) - F.col(launched)).alias("launch_delay_avg"),
    )
    return own.join(times, keys).withColumn("stage", F.col("step_time") - F.col("bubble"))


def with_stages(rows: DataFrame, step: str, rank: str, stage: str, metrics: list[str]) -> DataFrame:
    """Rows of ranks and, under them, a row for each stage with the largest of its ranks' metrics: type, index, step, metrics."""
    ranks = rows.select(F.lit("rank").alias("type"), F.col(rank).cast("string").alias("index"), step, *metrics)
    stages = rows.groupBy(step, stage).agg(*(F.max(m).alias(m) for m in metrics)).select(F.lit("stage").alias("type"), F.col(stage).cast("string").alias("index"), step, *metrics)
    return ranks.unionByName(stages)


def compared(current: DataFrame, base: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metric by metric: current, base and their difference; a key that one side lacks has nulls there and in the difference."""
    a = current.select(*keys, *(F.col(m).alias(f"{m}_current") for m in metrics))
    b = base.select(*keys, *(F.col(m).alias(f"{m}_base") for m in metrics))
    both = a.join(b, keys, "full")
    return both.select(*keys, *(c for m in metrics for c in (F.col(f"{m}_current"), F.col(f"{m}_base"), (F.col(f"{m}_current") - F.col(f"{m}_base")).alias(f"{m}_diff"))))


def top_ops(rows: DataFrame, op: str, value: str, rank: str, n: int = 15) -> DataFrame:
    """The n ops of the largest mean, with the nine figures of a summary and the ranks of their least and largest value."""
    figures = summary(rows, [op], value)
    ends = rows.groupBy(op).agg(F.min_by(rank, F.struct(value, rank)).alias("min_rank"), F.min_by(rank, F.struct(-F.col(value), F.col(rank))).alias("max_rank"))
    return figures.orderBy(F.desc("mean_value"), op).limit(n).join(ends, op)


def group_map(rows: DataFrame, group: str, rank: str) -> DataFrame:
    """Ranks of each communication group, in order, and the last three characters of its name as id."""
    ranks = rows.select(group, rank).distinct().groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(rank)), ",").alias("ranks"))
    return ranks.select(F.col(group).alias("group_name"), F.right(F.col(group), F.lit(3)).alias("group_id"), "ranks")


def marks(rows: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """The nine figures of each level's duration (framework, runtime, device) by the keys (name, step); rows without one are left out."""
    long = rows.unpivot(keys, levels, "level", "duration").filter("duration is not null")
    return summary(long, ["level", *keys], "duration")


def shares(rows: DataFrame, keys: list[str], within: list[str], value: str) -> DataFrame:
    """Count, total, mean, extremes of each group, and its share in percent of the total of `within`."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"), exact_sum(value).alias("total"), F.min(value).alias("min_value"), F.max(value).alias("max_value")).withColumn("mean_value", F.col("total") / F.col("n"))
    whole = by.groupBy(*within).agg(exact_sum("total").alias("_all"))
    joined = by.join(whole, within) if within else by.crossJoin(F.broadcast(whole))  # without keys the total is one row
    return joined.withColumn("share_pct", F.col("total") * 100.0 / F.nullif("_all", F.lit(0.0))).drop("_all")


def time_split(rows: DataFrame, keys: list[str], elapsed: str, transit: str, wait: str, sync: str, size: str) -> DataFrame:
    """Elapsed time of collectives split into transit, wait, synchronisation and idle (what is left), and their bandwidth."""
    total = {n: exact_sum(c).alias(n) for n, c in (("elapsed", elapsed), ("transit", transit), ("wait", wait), ("sync", sync), ("size", size))}
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *total.values())
    out = out.withColumn("idle", F.greatest(F.col("elapsed") - F.col("transit") - F.col("wait") - F.col("sync"), F.lit(0.0)))
    spent = F.nullif(F.col("transit") + F.col("wait"), F.lit(0.0))
    return out.withColumn("wait_ratio", F.coalesce(F.col("wait") / spent, F.lit(0.0))).withColumn("bandwidth", F.col("size") / F.nullif("transit", F.lit(0.0)))


#: Least bytes and expected bandwidth of a copy, an inline reduction and a remote access.
ANCHORS = (("copy", 16 << 20, 19.0), ("reduce", 16 << 20, 17.0), ("remote", 1 << 20, 21.0))


def transfer_class(kind: Column, size: Column, bandwidth: Column, low: float = 0.8) -> Column:
    """small below the anchor's bytes, slow below a share of its bandwidth, else normal; unknown for other kinds."""
    found = F.lit("unknown")
    for name, least, expected in ANCHORS:
        found = F.when(kind == name, F.when(size <= least, "small").when(bandwidth < expected * low, "slow").otherwise("normal")).otherwise(found)
    return found


def rank_outliers(rows: DataFrame, keys: list[str], rank: str, value: str, times: float = 2.0) -> DataFrame:
    """Ranks whose total is above `times` the mean total of the ranks of their group."""
    per = rows.groupBy(*keys, rank).agg(exact_sum(value).alias("total"))
    mean = per.groupBy(*keys).agg((exact_sum("total") / F.count("*")).alias("mean_total"))
    return per.join(mean, keys).filter(F.col("total") > times * F.col("mean_total"))


def host_bound(steps: DataFrame, share: float = 0.1) -> DataFrame:
    """Whether a step's device is free for more than a share of it: the schedule, not the device, holds it up."""
    return steps.withColumn("free_share", F.col("free") / F.nullif("step_time", F.lit(0))).withColumn("host_bound", F.coalesce(F.col("free_share") > share, F.lit(False)))


def module_mfu(rows: DataFrame, module: str, flops: Column, seconds: Column, peak_tflops: float) -> DataFrame:
    """Achieved teraflops and utilisation of each module: all its work over all its time."""
    by = rows.groupBy(module).agg(F.count("*").alias("kernels"), exact_sum(flops).alias("flops"), exact_sum(seconds).alias("seconds"))
    return by.withColumn("tflops", F.col("flops") / F.nullif("seconds", F.lit(0.0)) / 1e12).withColumn("mfu", F.col("tflops") / peak_tflops)
