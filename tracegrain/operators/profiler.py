"""Views over profiler tables: compute, communication and dispatch, with dictionary columns decoded."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.operators import scans


def named(rows: DataFrame, strings: DataFrame, **columns: str) -> DataFrame:
    """rows with a decoded column for each `name=code`, by left joins with the (id, value) dictionary; null if unknown.

    The dictionary is joined once for each role; Spark broadcasts it where it is small.
    """
    for to, code in columns.items():
        rows = rows.join(strings.select(F.col("id").alias(f"_{to}"), F.col("value").alias(to)), F.col(code) == F.col(f"_{to}"), "left").drop(f"_{to}")
    return rows


def compute_view(tasks: DataFrame, info: DataFrame, strings: DataFrame) -> DataFrame:
    timed = tasks.select("globalTaskId", "startNs", "endNs", "deviceId", "streamId")
    x = info.join(timed, "globalTaskId", "left").withColumn("durationNs", F.col("endNs") - F.col("startNs"))
    return named(x, strings, op_name="name", op_type="opType")


def communication_view(ops: DataFrame, strings: DataFrame) -> DataFrame:
    return named(ops.withColumn("durationNs", F.col("endNs") - F.col("startNs")), strings, op_name="opName", op_type_name="opType", group_name="groupName")


def dispatch_view(tasks: DataFrame, runtime: DataFrame, connections: DataFrame, framework: DataFrame, strings: DataFrame) -> DataFrame:
    """Device task to runtime call to framework call; several calls on one connection multiply rows, by definition."""
    a = tasks.select("globalTaskId", "connectionId", F.col("startNs").alias("task_start"), F.col("endNs").alias("task_end"), "taskType")
    b = runtime.select("connectionId", F.col("name").alias("api_code"), F.col("startNs").alias("api_start"))
    c = connections.select(F.col("id").alias("conn"), "connectionId")
    d = framework.select(F.col("connectionId").alias("conn"), F.col("name").alias("framework_code"), F.col("startNs").alias("framework_start"))
    x = a.join(b, "connectionId", "left").join(c, "connectionId", "left").join(d, "conn", "left")
    return named(x, strings, task_name="taskType", api_name="api_code", framework_name="framework_code").withColumn("dispatch_delay", F.col("task_start") - F.col("api_start"))


def thread_of(global_tid: Column) -> tuple[Column, Column]:
    """Process and thread packed in a 64-bit id."""
    return F.shiftrightunsigned(global_tid, 32), global_tid.bitwiseAND(F.lit(0xFFFFFFFF))


def top_ops(view: DataFrame, name: str, duration: str, n: int = 20) -> DataFrame:
    return view.groupBy(name).agg(F.count("*").alias("calls"), F.sum(duration).alias("total_duration"), F.max(duration).alias("longest")).orderBy(F.desc_nulls_last("total_duration"), F.asc_nulls_last(name)).limit(n)


def first_within(records: DataFrame, kernels: DataFrame, key: list[str], width: int) -> DataFrame:
    """For each record (record, start, end), the first kernel (kernel, at) that starts within it.

    Both sides are scanned in one order, back in time, so a record meets the next kernel only, however many start within it. Of kernels that start
    together the least counts. width: how long records are at most in the usual case; the result does not depend on it.
    """
    known = functools.reduce(lambda x, k: x & F.col(k).isNotNull(), key, F.lit(True))
    first = kernels.filter(known & F.col("at").isNotNull()).groupBy(*key, "at").agg(F.min("kernel").alias("kernel")).withColumn("_back_at", -F.col("at"))
    asked = records.filter(known & F.col("start").isNotNull()).select(*key, "record", "end", (-F.col("start")).alias("_back"))
    x = scans.as_of(asked, first, key, "_back", "_back_at", {"_kernel": "kernel", "_at": "at"}, "at").filter("_at < end")
    return x.groupBy(*key, "record").agg(F.min(F.struct(F.col("_at").alias("at"), F.col("_kernel").alias("kernel"))).alias("x")).select(*key, "record", "x.kernel", "x.at")
