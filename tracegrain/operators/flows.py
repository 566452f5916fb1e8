"""Association of host calls and device work: by flow id, by enclosing slice, and by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.operators import scans


def launched_by(tasks: DataFrame, calls: DataFrame, keys: list[str], task: str, at: str, call: str, start: str, end: str) -> DataFrame:
    """Each task with the host call that was running when it was launched: the innermost one, and how many enclose it; null and 0 without one."""
    found = scans.innermost(tasks, calls, keys, task, at, start, end, call)
    return scans.with_keys(tasks, found, [*keys, task]).withColumn("depth", F.coalesce("depth", F.lit(0)))


def last_before(tasks: DataFrame, calls: DataFrame, keys: list[str], at: str, start: str, take: dict[str, str], ties: str, longest: int | None = None) -> DataFrame:
    """Each task with columns of the latest call that began at or before it, not longer ago than `longest`; `waited` is the time between."""
    took = take | {"_began": start}
    out = scans.as_of(tasks, calls, keys, at, start, took, ties)
    waited = F.col(at) - F.col("_began")
    near = F.lit(True) if longest is None else waited <= longest
    return out.select(*tasks.columns, *(F.when(near, F.col(n)).alias(n) for n in take), F.when(near, waited).alias("waited"))


def flow_pairs(starts: DataFrame, ends: DataFrame, flow: str, at: str, name: str) -> DataFrame:
    """Each start of a flow with the first end of the same flow at or after it: flow, start_name, start_at, end_name, end_at; a start without one is kept.

    Flow ids may be used again, so the end is the next in time; both sides are scanned in one order.
    """
    a = starts.select(flow, F.col(name).alias("start_name"), F.col(at).alias("start_at"), (-F.col(at)).alias("_back"))
    b = ends.select(flow, F.col(name).alias("_name"), F.col(at).alias("_at"), (-F.col(at)).alias("_back_at"), F.xxhash64(name).alias("_tie"))
    out = scans.as_of(a, b, [flow], "_back", "_back_at", {"end_name": "_name", "end_at": "_at"}, "_name")
    return out.select(flow, "start_name", "start_at", "end_name", "end_at")


def flow_details(pairs: DataFrame, host: DataFrame, device: DataFrame, track: list[str], name: str, start: str, end: str) -> DataFrame:
    """Flow pairs with the host slice around their start and the device slice around their end (of one track): names, depths and the delay between."""
    numbered = pairs.withColumn("_pair", F.xxhash64(*pairs.columns))
    inner = lambda slices, at, to: scans.innermost(numbered.filter(F.col(at).isNotNull()), slices, track, "_pair", at, start, end, name).select(*track, "_pair", F.col(name).alias(to))
    out = scans.with_keys(numbered, inner(host, "start_at", "host_slice"), [*track, "_pair"])
    out = scans.with_keys(out, inner(device, "end_at", "device_slice"), [*track, "_pair"])
    return out.withColumn("delay", F.col("end_at") - F.col("start_at")).drop("_pair")
