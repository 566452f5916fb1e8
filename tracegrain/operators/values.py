"""Tensor statistics of two runs of a model compared value by value, and what the values say of each pair of modules.

A tensor is a row of run, key (its module), target (output.0, parameters.weight, input_args.0, input_kwargs), name (of a named
input, else empty), dtype, shape (array) and four statistics; a run, key, target and name has one row. A pair of modules is a row of
run, train_key and rollout_key. Statistics that one side lacks tell nothing; one that is NaN on either side is an alert. Tensors of
both runs may come as one table, so that what they are made from is read once: `trained` says which run a tensor is of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions import scalars
from tracegrain.operators.comparison import module_bucket

#: Statistics of a tensor, targets of a module, and names of what a compared value shows.
STATISTICS = ("Max", "Min", "Mean", "Norm")
OUTPUT, PARAMETER, ARGUMENT, NAMED = "output.0", "parameters.weight", "input_args.0", "input_kwargs"
SAME_SHAPE, SAME_SIZE, OTHER_SIZE = "value_mismatch_shape_match", "value_mismatch_numel_match", "value_mismatch_shape_mismatch"
SHAPE_ONLY, ALIKE, HARMLESS, LACKING = "value_match_shape_mismatch", "value_match_shape_match", "parameter_mismatch_output_aligned", "missing_compare_target"

PAIR = ["run", "train_key", "rollout_key"]


def worst_of(train: dict[str, Column], rollout: dict[str, Column]) -> Column:
    """alert, warn or ok: the worst error among the statistics that both sides have."""
    found = [scalars.error_bucket(train[m], rollout[m]) for m in train]
    some = lambda kind: reduce(Column.__or__, [x == kind for x in found])
    return F.when(some("alert"), "alert").when(some("warn"), "warn").otherwise("ok")


def value_bucket(differs: Column, relation: Column) -> Column:
    """Rank (1 is looked at first), bucket and status of a compared value."""
    of = lambda rank, name, status: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("bucket"), F.lit(status).alias("status"))
    reshaped = relation.isin("singleton_compatible_numel_match", "numel_match")
    other = relation == "numel_mismatch"
    return (
        F.when(differs & (relation == "exact_match"), of(1, SAME_SHAPE, "alert")).when(differs & reshaped, of(1, SAME_SIZE, "alert")).when(differs & other, of(2, OTHER_SIZE, "warn"))
        .when(~differs & (reshaped | other), of(3, SHAPE_ONLY, "warn")).otherwise(of(4, ALIKE, "ok"))
    )


#: Rows that make one part, as long as the session asks for no more parts.
ROWS = 1 << 18


def parts(spark: SparkSession, rows: int) -> int | None:
    """Into how many parts so many rows are dealt, so that a task's do not grow with the table; None where those the session asks for are enough."""
    n = -(-rows // ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys into n parts; as they are where n is None."""
    return rows.repartition(n, *keys) if n else rows


def compared(pairs: DataFrame, train: DataFrame, rollout: DataFrame) -> DataFrame:
    """`met` of the tensors of two tables, one of each run."""
    return met(pairs, train.withColumn("trained", F.lit(True)).unionByName(rollout.withColumn("trained", F.lit(False))))


def met(pairs: DataFrame, tensors: DataFrame, n: int | None = None) -> DataFrame:
    """Each target of each pair: consistency (match, mismatch, missing), relation of shapes, worst metric, rank, bucket, status.

    Tensors of both runs go to their pairs' keys in one shuffle, and meet in another by pair, which also tells what a pair's output says;
    each into n parts, if given. A parameter that differs where the pair's output agrees is rank 5.
    """
    of = lambda trained, key: F.struct(F.lit(trained).alias("trained"), F.col(key).alias("key"))
    keys = pairs.select(*PAIR, F.explode(F.array(of(True, "train_key"), of(False, "rollout_key"))).alias("_k")).select(*PAIR, "_k.*")
    on = ["run", "trained", "key"]
    # targets that are null are not equal
    at = F.struct("target", F.coalesce("name", F.lit("")).alias("name"), F.when(F.col("target").isNull(), F.col("trained")).alias("lone"))
    x = dealt(tensors, n, *on).join(dealt(keys, n, *on), on).select(*PAIR, "trained", at.alias("_at"), "dtype", F.struct("shape", *STATISTICS).alias("_s"))
    x = x.repartition(*([n] if n else []), *PAIR)
    own = lambda trained, c: F.first(F.when(F.col("trained") == trained, F.col(c)), True)
    sides = [own(trained, c).alias(name) for trained, c, name in ((True, "_s", "_t"), (False, "_s", "_r"), (True, "dtype", "_td"), (False, "dtype", "_rd"))]
    x = x.groupBy(*PAIR, "_at").agg(*sides).withColumns({"target": F.col("_at.target"), "name": F.col("_at.name")})
    there = F.col("_t").isNotNull() & F.col("_r").isNotNull()
    x = x.withColumn("worst_metric", F.when(there, worst_of(*({m: F.col(f"{s}.{m}") for m in STATISTICS} for s in ("_t", "_r")))).otherwise("missing"))
    differs = F.col("worst_metric").isin("warn", "alert")
    x = x.withColumn("consistency", F.when(~there, "missing").when(differs, "mismatch").otherwise("match")).withColumn("relation", F.when(there, scalars.shape_relation(F.col("_t.shape"), F.col("_r.shape"))).otherwise("unknown"))
    x = x.withColumn("same_dtype", there & F.col("_td").eqNullSafe(F.col("_rd"))).withColumn("_v", value_bucket(differs, F.col("relation")))
    agrees = F.coalesce(F.max((F.col("target") == OUTPUT) & (F.col("consistency") == "match")).over(Window.partitionBy(*PAIR)), F.lit(False))
    x = x.withColumn("_h", (F.col("target") == PARAMETER) & (F.col("consistency") == "mismatch") & agrees)
    rank = F.when(F.col("_h"), 5).when(there, F.col("_v.rank"))
    bucket = F.when(F.col("_h"), HARMLESS).when(there, F.col("_v.bucket")).otherwise(LACKING)
    status = F.when(F.col("_h"), "info").when(there, F.col("_v.status")).when(F.col("_t").isNull(), "missing_on_train").otherwise("missing_on_rollout")
    return x.select(*PAIR, "target", "name", "consistency", "relation", "same_dtype", "worst_metric", rank.alias("rank"), bucket.alias("bucket"), status.alias("status"))


def module_statuses(pairs: DataFrame, values: DataFrame, n: int | None = None, **more: Column) -> DataFrame:
    """Each pair with the status of its output, parameter, argument and named inputs, and its bucket and rank.

    values: rows of `compared` or `met`, there dealt into n parts. Named inputs together are a mismatch if one is, missing if no name is on
    both sides, partial if some are on one side only, not_applicable if there are none. more: further aggregates of a pair's values; null
    where it has none.
    """
    state = F.when(F.col("consistency") == "match", "aligned").otherwise(F.col("consistency"))
    one = lambda target: F.coalesce(F.max(F.when(F.col("target") == target, state)), F.lit("missing"))
    named = F.col("target") == NAMED
    count = lambda of: F.count_if(named & of)
    lacks = F.col("consistency") == "missing"
    both, single, bad = count(~lacks), count(lacks), count(F.col("consistency") == "mismatch")
    inputs = F.when(both + single == 0, "not_applicable").when(both == 0, "missing").when(bad > 0, "mismatch").when(single > 0, "partial").otherwise("aligned")
    further = [c.alias(name) for name, c in more.items()]
    found = values.groupBy(*PAIR).agg(one(OUTPUT).alias("output"), one(PARAMETER).alias("parameter"), one(ARGUMENT).alias("arguments"), inputs.alias("named"), *further)
    x = dealt(pairs.select(*PAIR), n, *PAIR).distinct().join(found, PAIR, "left").fillna("missing", ["output", "parameter", "arguments"]).fillna("not_applicable", ["named"])
    x = x.withColumn("_m", module_bucket(*(F.col(c) for c in ("train_key", "rollout_key", "output", "parameter", "arguments", "named"))))
    return x.select(*PAIR, "output", "parameter", "arguments", "named", F.col("_m.bucket").alias("bucket"), F.col("_m.rank").alias("module_rank"), *more)


def counted(values: DataFrame, modules: DataFrame) -> DataFrame:
    """How many values and modules each bucket holds: kind, bucket, n."""
    both = values.select(F.lit("value").alias("kind"), "bucket").unionByName(modules.select(F.lit("module").alias("kind"), "bucket"))
    return both.groupBy("kind", "bucket").agg(F.count("*").alias("n"))


def bucket_counts(pairs: DataFrame, values: DataFrame, n: int | None = None) -> DataFrame:
    """`counted` of values and of their modules, where the values are looked at once: each pair's are counted as its module is judged."""
    names = (SAME_SHAPE, SAME_SIZE, OTHER_SIZE, SHAPE_ONLY, ALIKE, HARMLESS, LACKING)
    modules = module_statuses(pairs, values, n, **{f"_{name}": F.count_if(F.col("bucket") == name) for name in names})
    of = lambda kind, bucket, count: F.struct(F.lit(kind).alias("kind"), bucket.alias("bucket"), count.alias("n"))
    found = F.array(of("module", F.col("bucket"), F.lit(1).cast("bigint")), *(of("value", F.lit(name), F.col(f"_{name}")) for name in names))
    return modules.select(F.inline(found)).filter("n > 0").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
