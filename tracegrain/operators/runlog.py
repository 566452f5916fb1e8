"""Logs of agent runs: calls and their results, latest rows, retained history, scores and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions import scalars
from tracegrain.operators.memory import exact_sum


def paired_calls(calls: DataFrame, results: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each call with its result; of several results the latest counts, a call without one keeps nulls."""
    last = results.groupBy(*key).agg(F.max_by(F.struct("*"), order).alias("_r"))
    return calls.join(last.select(*key, F.col(f"_r.{order}").alias("result_at"), F.col("_r.text").alias("result")), key, "left")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(order).alias("latest"))


def last_k(rows: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def offload(rows: DataFrame, key: str, order: str, text: str, keep: int) -> DataFrame:
    """Tokens of a history before and after all but its last `keep` rows are moved out."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    x = rows.withColumn("_t", scalars.token_estimate(F.col(text))).withColumn("_r", F.row_number().over(w))
    out = x.groupBy(key).agg(F.sum("_t").alias("tokens_before"), F.sum(F.when(F.col("_r") <= keep, F.col("_t")).otherwise(0)).alias("tokens_after"), F.sum((F.col("_r") > keep).cast("int")).cast("bigint").alias("moved"))
    return out.withColumn("saved_pct", (F.col("tokens_before") - F.col("tokens_after")) * 100.0 / F.nullif("tokens_before", F.lit(0)))


def run_report(runs: DataFrame, key: str, calls: Column, gates: Column, rubric: Column, budget: int = 20) -> DataFrame:
    """Efficiency, gated score and final score of each run."""
    x = runs.select(key, calls.alias("calls"), gates.alias("gates"), rubric.alias("rubric"))
    return x.withColumn("efficiency", scalars.efficiency(F.col("calls"), budget)).withColumn("score", scalars.gated_score(F.col("rubric"), F.col("gates"))).withColumn("final_score", F.col("score") * F.col("efficiency"))


def suite_report(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("cases"), (exact_sum("final_score") / F.count("*")).alias("mean_score"), F.sum(F.col("gates").cast("int")).cast("bigint").alias("passed"), F.sum("calls").alias("total_calls"))


def deduplicated_usage(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Total of a value over distinct messages; null if all are."""
    return rows.dropDuplicates(key).agg(F.sum(value).alias("total"))


def envelope_errors(text: Column) -> Column:
    """Codes of what is wrong with a JSON envelope {protocol, type, status, commands: [...]}, in this order."""
    field = lambda name: F.get_json_object(text, f"$.{name}")
    wrong = {
        "malformed": F.try_parse_json(text).isNull(),
        "protocol": field("protocol").isNull(),
        "type": ~F.coalesce(field("type").isin("delegation_input", "delegation_output"), F.lit(False)),
        "status": (field("type") == "delegation_output") & ~F.coalesce(field("status").isin("success", "failed", "partial"), F.lit(False)),
        "commands": field("commands").isNotNull() & ~field("commands").startswith("["),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in wrong.items())))


def first_rule(rows: DataFrame, value: str, rules: list[tuple[str, str]], default: str = "ask") -> DataFrame:
    """Decision of the first rule (regular expression, decision) that fits a value."""
    found = F.lit(default)
    for pattern, decision in reversed(rules):
        found = F.when(F.col(value).rlike(pattern), decision).otherwise(found)
    return rows.withColumn("decision", found)


def token_bucket(rows: DataFrame, key: str, at: str, cost: str, rate: float, size: float) -> DataFrame:
    """Requests that a bucket of `size`, refilled at `rate` a second, lets through, and what is left after the last: key, passed, refused, level.

    Rows are dealt by key, sorted in their partition by time and cost, and folded batch by batch: a task holds one key's state, whatever its history.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, none = None, None, object()
        now = none

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], fields[0]), pa.array([state[2]], pa.int64()), pa.array([state[3]], pa.int64()), pa.array([state[0]], pa.float64())], ["key", "passed", "refused", "level"])

        fields: list[pa.DataType] = []
        for batch in batches:
            fields = fields or [batch.schema.field(0).type]
            for k, t, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is none or k != now:
                    if now is not none:
                        yield done()
                    now, state = k, [size, None, 0, 0]
                passed = 0.0 if state[1] is None or t is None else t - state[1]
                level = min(size, state[0] + passed * rate)
                fits = c is not None and level >= c
                state = [level - c if fits else level, state[1] if t is None else t, state[2] + fits, state[3] + (not fits)]
        if now is not none:
            yield done()

    ordered = rows.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(cost).cast("double").alias("cost")).repartition("key").sortWithinPartitions("key", "at", "cost")
    return ordered.mapInArrow(run, f"key {kind}, passed bigint, refused bigint, level double").withColumnRenamed("key", key)
