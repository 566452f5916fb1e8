"""Kernels of devices: where their time goes, marks that carry their work, and gaps in which nothing ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions import scalars
from tracegrain.operators import profiler, scans, steps
from tracegrain.operators.memory import exact_sum


def top_kernels(rows: DataFrame, device: list[str], op: list[str], duration: str, n: int = 10) -> DataFrame:
    """The n ops of each device that took the most time: calls, total, mean, extremes, share of the device and place (from 1).

    Ops are added up before they are ranked, and Spark keeps n of a device in each task before they meet. Ties go to the lesser op.
    """
    by = steps.shares(rows, [*device, *op], device, duration)
    place = F.row_number().over(Window.partitionBy(*device).orderBy(F.desc_nulls_last("total"), *(F.asc_nulls_first(c) for c in op)))
    return by.withColumn("place", place).filter(F.col("place") <= n)


def spread(rows: DataFrame, by: list[str], duration: str) -> DataFrame:
    """Kernels and time of each device (or core type, or stream) and its share in percent of all kernels and all time."""
    each = rows.groupBy(*by).agg(F.count("*").alias("kernels"), exact_sum(duration).alias("total"))
    whole = each.agg(F.sum("kernels").alias("_n"), exact_sum("total").alias("_all"))  # one row
    out = each.crossJoin(F.broadcast(whole))
    return out.select(*by, "kernels", "total", (F.col("kernels") * 100.0 / F.col("_n")).alias("kernels_pct"), (F.col("total") * 100.0 / F.nullif("_all", F.lit(0.0))).alias("total_pct"))


def dynamic_split(rows: DataFrame, by: list[str], dynamic: Column, duration: str) -> DataFrame:
    """Kernels and time of dynamic and static shapes, and dynamic kernels for each static one (null without static ones); an unknown state counts as static."""
    is_dynamic = F.coalesce(dynamic, F.lit(False))
    x = rows.withColumn("_d", is_dynamic)
    of = lambda state: exact_sum(F.when(F.col("_d") == state, F.col(duration)).otherwise(0.0))
    out = x.groupBy(*by).agg(F.count_if("_d").alias("dynamic"), F.count_if(~F.col("_d")).alias("static"), of(True).alias("dynamic_time"), of(False).alias("static_time"))
    return out.withColumn("dynamic_ratio", F.col("dynamic") / F.nullif("static", F.lit(0)))


def marks(events: DataFrame, strings: DataFrame, domain: str, message: str, wanted: str) -> DataFrame:
    """Marks of one domain with their message decoded (`text`); marks with an unknown domain or message are left out.

    The domain's codes are few, so they are looked up first and only its marks meet the messages.
    """
    codes = strings.filter(F.col("value") == wanted).select(F.col("id").alias(domain)).distinct()
    return events.join(codes, domain, "left_semi").join(strings.select(F.col("id").alias(message), F.col("value").alias("text")), message)


def marked_work(records: DataFrame, kernels: DataFrame, key: list[str], width: int, peak_tflops: Column | float) -> DataFrame:
    """Work of each mark (record, start, end, flops) on the first kernel (kernel, at, until; microseconds) that starts within it.

    Gives the kernel's time in seconds, achieved teraflops, utilisation and its band; a mark without a kernel has nulls there.
    """
    found = profiler.first_within(records, kernels.select(*key, "at", F.struct("kernel", "until").alias("kernel")), key, width)
    x = records.join(found, [*key, "record"], "left").select(*key, "record", "flops", F.col("kernel.kernel").alias("kernel"), ((F.col("kernel.until") - F.col("at")) / 1e6).alias("seconds"))
    x = x.withColumn("tflops", F.col("flops") / F.nullif("seconds", F.lit(0.0)) / 1e12).withColumn("mfu", F.col("tflops") / peak_tflops)
    return x.withColumn("band", F.when(F.col("mfu").isNotNull(), scalars.mfu_band(F.col("mfu"))))


def quiet(gaps: DataFrame, busy: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """gaps with `quiet`: whether no interval of busy runs in any part of the gap (start <= t < end, on both sides).

    A gap is not quiet if of the intervals that begin before its end one ends after its start: one running maximum over both
    sides in one order, without pairs. Empty intervals are never busy.
    """
    one = gaps.select(*keys, F.struct(*gaps.columns).alias("_gap"), F.col(end).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(gaps.schema[end].dataType).alias("_end"))
    two = busy.filter(F.col(start) < F.col(end)).select(*keys, F.lit(None).cast(one.schema["_gap"].dataType).alias("_gap"), F.col(start).alias("_t"), F.lit(1).alias("_side"), F.col(end).alias("_end"))
    x = scans.scanned(one.unionByName(two), keys, ["_t", "_side"], {"_latest": ("max", F.col("_end"), False)}).filter("_gap is not null")
    return x.select("_gap.*", (~F.coalesce(F.col("_latest") > F.col(f"_gap.{start}"), F.lit(False))).alias("quiet"))


def schedule_gaps(gaps: DataFrame, compute: DataFrame, communication: DataFrame, keys: list[str], start: str, end: str, step_time: str, share: float = 0.1) -> DataFrame:
    """Gaps that the schedule is to blame for: above a share of their step's time, with neither compute nor communication in them."""
    cut = [*keys, start, end]
    out = quiet(gaps, compute.select(*cut).unionByName(communication.select(*cut)), keys, start, end)
    part = (F.col(end) - F.col(start)) / F.nullif(step_time, F.lit(0))
    return out.withColumn("share", part).withColumn("host_bound", F.col("quiet") & F.coalesce(F.col("share") > share, F.lit(False)))
