"""Two runs of a model compared: mapped modules, what their differences mean, where to look first, and dumps row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.scalars import block_kind, layer_index
from tracegrain.functions.textual import fused_pair

#: Parts of the names of modules that activate.
ACTIVATIONS = ("act_fn", "silu", "swiglu", "gelu", "mul", "activation")


def activation_like(key: Column) -> Column:
    small = F.lower(key)
    return reduce(Column.__or__, [small.contains(x) for x in ACTIVATIONS])


def mapped(train: DataFrame, mapping: DataFrame, rollout: DataFrame, run: str, key: str, peers: str) -> DataFrame:
    """Each training module with its mapped modules that the other side has, in order, and 1:0, 1:1 or 1:N.

    train, rollout: run and key; mapping: key and a list of keys. A list's own order does not matter, a repeat counts once.
    """
    wanted = mapping.select(key, F.explode(F.array_distinct(peers)).alias("rollout_key"))
    there = rollout.select(run, F.col(key).alias("rollout_key")).distinct()
    found = train.select(run, key).join(wanted, key).join(there, [run, "rollout_key"]).groupBy(run, key).agg(F.sort_array(F.collect_set("rollout_key")).alias("rollout_keys"))
    n = F.size("rollout_keys")
    out = train.select(run, key).distinct().join(found, [run, key], "left").withColumn("rollout_keys", F.coalesce("rollout_keys", F.array().cast("array<string>")))
    return out.withColumn("cardinality", F.when(n == 0, "1:0").when(n == 1, "1:1").otherwise("1:N")).withColumn("confidence", F.when(n == 0, "low").otherwise("high"))


def input_status(arguments: Column, named: Column) -> Column:
    """Status of both kinds of inputs together: a mismatch in either, else aligned if either was compared."""
    known = lambda x: ~F.coalesce(x, F.lit("missing")).isin("missing", "not_applicable")
    return F.when((known(arguments) & (arguments == "mismatch")) | (known(named) & (named == "mismatch")), "mismatch").when(known(arguments) | known(named), "aligned").otherwise("missing")


def module_bucket(train: Column, rollout: Column, output: Column, parameter: Column, arguments: Column, named: Column) -> Column:
    """Bucket of a pair of modules and its rank (1 is looked at first), from what is aligned, a mismatch or missing."""
    output, parameter, named = (F.coalesce(x, F.lit("missing")) for x in (output, parameter, named))
    inputs = input_status(arguments, named)
    premise = (parameter == "missing") | named.isin("missing", "partial")
    same_inputs, same_parameters = inputs == "aligned", parameter == "aligned"
    of = lambda name, rank: F.struct(F.lit(name).alias("bucket"), F.lit(rank).alias("rank"))
    return (
        F.when((output == "mismatch") & same_inputs & fused_pair(train, rollout), of("fused_qkv_structural_mismatch", 5))
        .when((output == "aligned") & same_inputs & same_parameters, of("normal_aligned", 4))
        .when((output == "aligned") & premise, of("comparison_premise_abnormal_but_output_aligned", 5))
        .when(output == "aligned", of("internal_difference_but_output_aligned", 5))
        .when(output != "mismatch", of("insufficient_output_evidence", 3))
        .when(same_inputs & same_parameters, of("module_impl_mismatch", 1))
        .when(same_inputs, of("parameter_sync_mismatch", 1))
        .when(same_parameters, of("upstream_propagation_or_amplification", 2))
        .otherwise(of("systemic_misalignment", 2))
    )


def candidate_class(bucket: Column, activation_between: Column) -> Column:
    """What a suspect's difference may come from."""
    return (
        F.when(activation_between, "missing_or_extra_op_between_aligned_boundary").when(bucket == "parameter_sync_mismatch", "parameter_or_checkpoint_issue")
        .when(bucket == "module_impl_mismatch", "in_module_impl_difference").when(bucket.isin("upstream_propagation_or_amplification", "systemic_misalignment"), "upstream_propagation")
        .otherwise("needs_manual_review")
    )


def _unmatched(side: DataFrame, run: str) -> DataFrame:
    """For each place of a run: unmatched modules up to it, and the next unmatched one after it that activates."""
    w = Window.partitionBy(run).orderBy("pos")
    later = Window.partitionBy(run).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(~F.col("matched") & activation_like(F.col("key")), F.struct("pos", "key"))
    return side.select(run, "pos", F.sum((~F.col("matched")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.last(hit, ignorenulls=True).over(later).alias("next"))


def suspects(modules: DataFrame, train: DataFrame, rollout: DataFrame, run: str) -> DataFrame:
    """Modules of rank 1 and 2 in the order in which to look at them.

    modules: run, at (order), train_key, rollout_key, train_pos, rollout_pos, output, bucket, module_rank; train, rollout:
    run, pos (unique in a run), key, matched. A suspect's boundary is the nearest aligned module before it of its layer
    and block; unmatched modules between the two are counted on each side, and the first that activates is named.
    Pairs that differ by fusion only are left out. Running counts stand in for the lists between, so no row meets all others.
    """
    block = Window.partitionBy(run, layer_index(F.col("train_key")), block_kind(F.col("train_key"))).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    aligned = F.when(F.col("output") == "aligned", F.struct("train_key", "train_pos", "rollout_pos"))
    x = modules.withColumn("_b", F.last(aligned, ignorenulls=True).over(block)).filter(F.col("module_rank").isin(1, 2) & ~fused_pair(F.col("train_key"), F.col("rollout_key")))
    for name, side in (("train", train), ("rollout", rollout)):
        own = F.col(f"{name}_pos")
        known = _unmatched(side, run)
        first = known.select(run, F.col("pos").alias("_from"), F.col("so_far").alias("_low"), F.col("next").alias("_next"))
        last = known.select(run, F.col("pos").alias(f"{name}_pos"), F.col("so_far").alias("_high"))
        before = F.col("_from") < own
        # a suspect is matched itself, so what stands up to it stands before it
        x = x.withColumn("_from", F.col(f"_b.{name}_pos")).join(first, [run, "_from"], "left").join(last, [run, f"{name}_pos"], "left")
        x = x.withColumn(f"missing_{name}", F.when(before, F.col("_high") - F.col("_low")).otherwise(0).cast("bigint"))
        x = x.withColumn(f"first_{name}", F.when(before & (F.col("_next.pos") < own), F.col("_next.key"))).drop("_from", "_low", "_next", "_high")
    x = x.withColumn("class", candidate_class(F.col("bucket"), F.col("first_rollout").isNotNull() | F.col("first_train").isNotNull()))
    order = Window.partitionBy(run).orderBy(F.when(F.col("class") == "missing_or_extra_op_between_aligned_boundary", 0).otherwise(1), "module_rank", "at")
    names = ["train_key", "rollout_key", "module_rank", "bucket", "class", F.col("_b.train_key").alias("boundary"), "missing_train", "missing_rollout", "first_train", "first_rollout"]
    return x.withColumn("place", F.row_number().over(order)).select(run, "place", *names)


def api_states(rows: DataFrame, keys: list[str], order: str, api: str, is_input: Column, equal: Column) -> DataFrame:
    """Runs of neighbouring rows of one API, numbered from 1, and whether all inputs and all outputs of each agree.

    A side without rows agrees.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(api).eqNullSafe(F.lag(api).over(w)) | (F.row_number().over(w) == 1)).cast("bigint")
    x = rows.withColumn("_new", new).withColumn("place", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_in", is_input).withColumn("_same", F.coalesce(equal, F.lit(False)))
    return x.groupBy(*keys, "place").agg(F.first(api).alias(api), F.bool_and(~F.col("_in") | F.col("_same")).alias("input_match"), F.bool_and(F.col("_in") | F.col("_same")).alias("output_match"))


def first_problem(states: DataFrame, keys: list[str], api: str, left_out: Column | None = None) -> DataFrame:
    """The first API of each file with equal inputs and different outputs; without one, the last good API before the first
    with different inputs, that one, and how many lie between. APIs left out keep their places, and are none of the three."""
    states = states if left_out is None else states.filter(~left_out)
    here = F.struct("place", api)
    same, out = F.col("input_match"), F.col("output_match")
    marks = states.groupBy(*keys).agg(F.min(F.when(same & ~out, here)).alias("hit"), F.min(F.when(~same, here)).alias("bad"))
    good = states.join(marks.select(*keys, F.col("bad.place").alias("_stop")), keys).filter(same & out & (F.col("_stop").isNull() | (F.col("place") < F.col("_stop"))))
    x = marks.join(good.groupBy(*keys).agg(F.max(here).alias("good")), keys, "left")
    none = F.col("hit").isNull()
    between = F.greatest(F.col("bad.place") - F.col("good.place") - 1, F.lit(0))
    return x.select(*keys, F.col(f"hit.{api}").alias("first_api"), F.when(none, F.col(f"good.{api}")).alias("last_good"), F.when(none, F.col(f"bad.{api}")).alias("first_bad"), F.when(none, between).alias("between"))


def modules_only(rows: DataFrame, keys: list[str], order: str, name: str, looked_at: int = 100) -> DataFrame:
    """Whether all named ones of the first rows of a dump are modules, so that it holds no APIs (the dump's own rule looks at 100)."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= looked_at)
    named = F.coalesce(F.col(name), F.lit("")) != ""
    module = F.col(name).startswith("Module.") | F.col(name).startswith("Cell.")
    return first.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(named, module)), F.lit(False)).alias("modules_only"))
