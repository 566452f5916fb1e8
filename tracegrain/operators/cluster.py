"""Ranks against ranks: operator statistics, communication time, links, waits and NaN propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions import scalars
from tracegrain.operators import scans
from tracegrain.operators.memory import exact_sum


def decoded(rows: DataFrame, code: str, names: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """Dictionary decoding that falls back to the code as text."""
    return rows.join(names.select(F.col(key).alias(code), F.col(value).alias("_value")), code, "left").withColumn(to, F.coalesce("_value", F.col(code).cast("string"))).drop("_value")


def op_stats(rows: DataFrame, name: str, time: str, count: Column | None = None, keep_null: bool = True) -> DataFrame:
    """Total time and count of each op. Tables keep a null name as a group, text files drop it."""
    rows = rows if keep_null else rows.filter(F.col(name).isNotNull())
    return rows.groupBy(F.col(name).alias("op")).agg(exact_sum(time).alias("total_time"), F.sum(F.lit(1) if count is None else count).cast("bigint").alias("n"))


def rank_diff(slow: DataFrame, fast: DataFrame, n: int = 20) -> DataFrame:
    """Ops of the slow rank against the fast one, by absolute difference. What only the fast rank has is left out."""
    other = fast.select("op", F.col("total_time").alias("fast_time"), F.col("n").alias("fast_n"))
    both = slow.select("op", F.col("total_time").alias("slow_time"), F.col("n").alias("slow_n")).join(other, "op", "left").na.fill(0.0, ["fast_time"]).na.fill(0, ["fast_n"])
    mean = lambda t, c: F.when(F.col(c) > 0, F.col(t) / F.nullif(F.col(c), F.lit(0))).otherwise(0.0)
    out = both.withColumn("diff", F.col("slow_time") - F.col("fast_time")).withColumn("ratio", scalars.ratio(F.col("slow_time"), F.col("fast_time"))).withColumn("avg_diff", mean("slow_time", "slow_n") - mean("fast_time", "fast_n"))
    return out.orderBy(F.abs("diff").desc(), F.asc_nulls_first("op")).limit(n)


def communication_stats(rows: DataFrame, name: str, group: str, elapsed: str) -> DataFrame:
    """Two levels: by op name and group, then by op type and group. op_count counts names, not calls."""
    first = rows.groupBy(name, F.coalesce(group, F.lit("")).alias("comm_group")).agg(exact_sum(elapsed).alias("total"), F.max(elapsed).alias("longest"))
    second = first.groupBy("comm_group", scalars.op_type(F.col(name)).alias("op_type")).agg(F.count("*").alias("op_count"), exact_sum("total").alias("total_elapse"), F.max("longest").alias("max_elapse"))
    # the second level is a few rows for each group; its total is one row
    total = second.agg(exact_sum("total_elapse").alias("_all"))
    return second.join(F.broadcast(total)).withColumn("share", F.col("total_elapse") / F.nullif(F.col("_all"), F.lit(0.0))).withColumn("avg_op_elapse", F.col("total_elapse") / F.col("op_count")).drop("_all")


def link_overview(rows: DataFrame, keys: list[str], op: str, source: str, target: str, size: str, time: str, bandwidth: Column, low: float = 10.0) -> DataFrame:
    rows = rows.withColumn("_bw", bandwidth)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.count_distinct(op).alias("op_count"), F.count_distinct(F.concat_ws("->", F.col(source).cast("string"), F.col(target).cast("string"))).alias("pair_count"),
        exact_sum(size).alias("total_size"), exact_sum(time).alias("total_time"), exact_sum("_bw").alias("_sum"), F.count("_bw").alias("_n"), F.min("_bw").alias("min_bw"), F.max("_bw").alias("max_bw"),
        F.sum((F.coalesce(F.col("_bw") < low, F.lit(False))).cast("int")).cast("bigint").alias("low_count"),
    ).withColumn("avg_bw", F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).drop("_sum", "_n")


def wait_evidence(rows: DataFrame, keys: list[str], rank: str, start_us: str, elapsed_ms: str, wait_ms: str) -> DataFrame:
    """Timing of one collective across ranks. Zero starts count as missing; ties go to the smaller start, then rank."""
    x = rows.select(*keys, F.col(rank).alias("rank"), scalars.safe_double(F.col(start_us)).alias("start"), scalars.safe_double(F.col(elapsed_ms)).alias("elapsed"), scalars.safe_double(F.col(wait_ms)).alias("wait"))
    x = x.withColumn("end", F.col("start") + F.col("elapsed") * 1000)
    began, ended = F.nullif("start", F.lit(0.0)), F.nullif("end", F.lit(0.0))
    by = lambda value: F.min_by("rank", F.struct(value, F.col("start"), F.col("rank")))
    out = x.groupBy(*keys).agg(
        F.count("*").alias("rank_count"), exact_sum("wait").alias("sum_wait"), exact_sum("elapsed").alias("sum_elapsed"), F.max("wait").alias("max_wait"), F.max("elapsed").alias("max_elapsed"), F.min("elapsed").alias("min_elapsed"),
        ((F.max(began) - F.min(began)) / 1000).alias("start_span"), F.coalesce((F.max(ended) - F.min(ended)) / 1000, F.lit(0.0)).alias("end_span"),
        by(F.coalesce(began, F.lit(float("inf")))).alias("earliest_rank"), by(-F.coalesce(began, F.lit(float("-inf")))).alias("latest_rank"), by(-F.col("elapsed")).alias("longest_rank"), by(F.col("elapsed")).alias("shortest_rank"),
    )
    out = out.filter("start_span is not null").withColumn("skew", F.col("max_elapsed") - F.col("min_elapsed"))
    out = out.withColumn("wait_ratio", F.when(F.col("sum_elapsed") != 0, F.col("sum_wait") / F.nullif("sum_elapsed", F.lit(0.0))).otherwise(0.0)).withColumn("duration_ratio", F.col("max_elapsed") / F.greatest("min_elapsed", F.lit(1e-9)))
    return out.withColumn("pattern", scalars.wait_pattern(F.col("start_span"), F.col("end_span"), F.col("skew"), F.col("earliest_rank"), F.col("longest_rank")))


def nan_sources(rows: DataFrame, op: str, rank: str, bad_input: Column, bad_output: Column) -> DataFrame:
    """Ranks that brought a NaN into an op, that only passed one on, and that had none; ops without one are left out.

    Ranks are as many as devices, so their lists are short.
    """
    per = rows.groupBy(op, rank).agg(F.bool_or(bad_input).alias("i"), F.bool_or(bad_output).alias("o"))
    ranks = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col(rank)))), ",")
    out = per.groupBy(op).agg(ranks(F.col("i")).alias("source"), ranks(~F.col("i") & F.col("o")).alias("propagated"), ranks(~F.col("i") & ~F.col("o")).alias("normal"), F.count("*").alias("n_ranks"))
    return out.filter("source <> '' or propagated <> ''")


def slow_ranks(rows: DataFrame, keys: list[str], rank: str, wait: str) -> DataFrame:
    """Votes for the slowest rank: of each collective, the one that waited least; ties to the smaller rank. Our own rule."""
    return rows.groupBy(*keys).agg(F.min_by(rank, F.struct(wait, rank)).alias("slow_rank")).groupBy("slow_rank").agg(F.count("*").alias("affected"))


def outlier_links(rows: DataFrame, transport: str, bandwidth: str, share: float = 0.5) -> DataFrame:
    """Links below a share of the mean bandwidth of their transport."""
    mean = rows.groupBy(transport).agg((exact_sum(bandwidth) / F.count("*")).alias("mean_bw"))
    return rows.join(F.broadcast(mean), transport).filter(F.col(bandwidth) < F.col("mean_bw") * share)


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation (of a sample), quartiles, extremes and sum of each group; no task holds a group's values."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("std_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), exact_sum(value).alias("sum_value"))
    out = scans.with_keys(out, scans.percentiles(rows, keys, value, {"q1": 0.25, "median_value": 0.5, "q3": 0.75}), keys)
    return out.select(*keys, "n", (F.col("sum_value") / F.col("n")).alias("mean_value"), "std_value", "min_value", "q1", "median_value", "q3", "max_value", "sum_value")


def extreme_ranks(rows: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """Ranks that attain the least and the largest value of each group, as ordered lists."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = rows.join(ends, keys).filter((F.col(value) == F.col("_low")) | (F.col(value) == F.col("_high")))
    ranks = lambda end: F.array_join(F.sort_array(F.collect_set(F.when(F.col(value) == F.col(end), F.col(rank)))), ",")
    return at.groupBy(*keys).agg(ranks("_low").alias("min_ranks"), ranks("_high").alias("max_ranks"))


def percentiles(rows: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """Count, total, mean, least, p50, p90, p95, p99 and largest value with when it happened."""
    largest = F.max_by(F.struct(F.col(value).alias("v"), F.col(at).alias("t")), F.struct(F.col(value), -F.col(tie))).alias("_x")
    out = rows.groupBy(key).agg(F.count("*").alias("n"), exact_sum(value).alias("total"), F.min(value).alias("min_value"), F.count(value).alias("_n"), largest)
    out = scans.with_keys(out, scans.percentiles(rows, [key], value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), [key])
    return out.select(key, "n", "total", (F.col("total") / F.nullif("_n", F.lit(0))).alias("mean_value"), "min_value", "p50", "p90", "p95", "p99", F.col("_x.v").alias("max_value"), F.col("_x.t").alias("max_at"))


def busy_time(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Span, union of the intervals, free time between them and gaps of each group: gaps and islands by a scanned maximum."""
    x = scans.scanned(intervals.select(*keys, start, end), keys, [start, end], {"_before": ("max", F.col(end), False)})
    gap = F.greatest(F.col(start) - F.col("_before"), F.lit(0))
    out = x.groupBy(*keys).agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.coalesce(F.sum(gap), F.lit(0)).alias("free_time"), F.sum((gap > 0).cast("int")).alias("gaps"), F.max(F.coalesce(gap, F.lit(0))).alias("largest_gap"))
    return out.withColumn("span", F.col("last_end") - F.col("first_start")).withColumn("busy_time", F.col("span") - F.col("free_time")).na.fill(0, ["gaps"])


def swept(intervals: DataFrame, keys: list[str], start: str, end: str, flags: dict[str, Column]) -> DataFrame:
    """Pieces between neighbouring starts and ends of a group: keys, piece (its length), and of each flag how many of its intervals run."""
    ends = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))))
    points = intervals.select(*keys, *(v.cast("int").alias(k) for k, v in flags.items()), ends.alias("e")).select(*keys, F.col("e.t").alias("t"), *((F.col(k) * F.col("e.d")).alias(k) for k in flags))
    points = points.groupBy(*keys, "t").agg(*(F.sum(k).alias(f"_{k}") for k in flags))
    x = scans.scanned(points, keys, ["t"], {"_since": ("last", F.col("t"), False)} | {k: ("sum", F.col(f"_{k}"), False) for k in flags})
    return x.select(*keys, (F.col("t") - F.col("_since")).alias("piece"), *flags)


def overlap_time(intervals: DataFrame, keys: list[str], start: str, end: str, kind: str, a: str, b: str) -> DataFrame:
    """Time in which intervals of kinds a and b run together, by a sweep over starts and ends."""
    x = swept(intervals.filter(F.col(kind).isin(a, b)), keys, start, end, {"na": F.col(kind) == a, "nb": F.col(kind) == b})
    return x.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(c, F.col("piece"))), F.lit(0)).alias(n) for n, c in (("time_a", F.col("na") > 0), ("time_b", F.col("nb") > 0), ("time_both", (F.col("na") > 0) & (F.col("nb") > 0)))))


def group_stats(rows: DataFrame, groups: DataFrame, name: str, group: str, elapsed: str, total_name: str | None = "Total Op Info") -> DataFrame:
    """Total, mean and longest time by op and group, with what groups (group_name, group_id, pg_name, ...) tell of the group: '' if nothing.

    A null group is ''; a group that stands twice in groups counts its rows twice, by definition. total_name: the row of totals that is left out.
    """
    kept = rows if total_name is None else rows.filter(F.col(name) != total_name)
    told = [c for c in groups.columns if c != "group_name"]
    by = kept.groupBy(name, F.coalesce(group, F.lit("")).alias("group_name")).agg(exact_sum(elapsed).alias("_total"), F.count(elapsed).alias("_n"), F.max(elapsed).alias("_longest"))
    # rows are added up before they meet their group; what the group tells is part of the key
    x = by.join(groups, "group_name", "left").select(name, "group_name", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in told), "_total", "_n", "_longest")
    out = x.groupBy(name, "group_name", *told).agg(exact_sum("_total").alias("total_elapse"), F.sum("_n").alias("_n"), F.max("_longest").alias("max_elapse"))
    return out.withColumn("avg_elapse", F.col("total_elapse") / F.nullif("_n", F.lit(0))).drop("_n")
