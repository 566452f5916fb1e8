"""Event streams: pairing of calls and results, windows with late data, and token buckets as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def paired(calls: DataFrame, results: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Each call (run_id, call_id, at) with its result (same columns) of the same run, or none after `within`: an outer stream join."""
    c = calls.withWatermark("at", within).select("run_id", "call_id", F.col("at").alias("called_at"))
    r = results.withWatermark("at", within).select(F.col("run_id").alias("r_run"), F.col("call_id").alias("r_call"), F.col("at").alias("result_at"))
    on = (F.col("run_id") == F.col("r_run")) & (F.col("call_id") == F.col("r_call")) & (F.col("result_at") >= F.col("called_at")) & (F.col("result_at") <= F.col("called_at") + F.expr(f"INTERVAL {within}"))
    return c.join(r, on, "left_outer").drop("r_run", "r_call")


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of `value` by event_type and event-time window; what comes later than `late` is dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")


def distinct_messages(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def token_bucket(requests: DataFrame, rate: float, size: float) -> DataFrame:
    """key, at, cost (seconds and tokens) with whether the key's bucket lets the request through, in the order of `at` within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (size, None)
        rows = pd.concat(list(batches)).sort_values(["at", "cost"])
        passed = []
        for at, cost in zip(rows["at"], rows["cost"], strict=True):
            left, last = min(size, left + (at - last if last is not None else 0.0) * rate), at
            passed.append(left >= cost)
            left -= cost if left >= cost else 0.0
        state.update((left, last))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "cost": rows["cost"], "passed": passed})

    return requests.groupBy("key").applyInPandasWithState(step, "key bigint, at double, cost double, passed boolean", "left double, last double", "append", GroupStateTimeout.NoTimeout)
