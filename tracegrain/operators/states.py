"""States that grow with a log: reduced fields, and calls that wait for their result until the next run begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.operators.scans import scanned


def reduced(rows: DataFrame, key: str, order: str, add: list[str] = (), replace: list[str] = (), merge: list[str] = ()) -> DataFrame:
    """The state of each key after its updates in order: sums (null is 0), last values that are not null (0 without one, as for sums), merged maps.

    Of a map's entries the last for each name counts, whatever its value. Partial results meet in each aggregate, so a key's updates never meet in one list; maps meet by name.
    """
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), F.lit(0))
    out = rows.groupBy(key).agg(F.count("*").alias("updates"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in add), *(last(c).alias(c) for c in replace))
    for c in merge:
        entries = rows.select(F.col(key).alias("_key"), order, F.explode(c).alias("name", "value")).groupBy("_key", "name").agg(F.max_by("value", order).alias("value"))
        maps = entries.groupBy("_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias(c))
        none = F.create_map().cast(rows.schema[c].dataType)
        out = out.join(maps, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(c, F.coalesce(c, none)).drop("_key")
    return out


def calls(rows: DataFrame, key: str, order: str, item: str, begins: Column, is_call: Column, is_result: Column) -> DataFrame:
    """Each call with the place of its result: key, run, item, called_at, result_at, state.

    Runs begin at `begins` rows, which drop what still waits. A result ends the last call of its item in the same run, once. state: done, replaced (by
    another call of the item), expired (a run began), pending.
    """
    x = rows.select(key, order, item, begins.cast("int").alias("_b"), is_call.alias("_c"), is_result.alias("_r"))
    x = scanned(x, [key], [order], {"run": ("sum", F.col("_b"), True)})
    last = x.groupBy(F.col(key).alias("_key")).agg(F.max("run").alias("_last"))
    w = Window.partitionBy(key, "run", item).orderBy(order)  # the calls and results of one item in one run
    x = x.filter("_c or _r").select("*", F.lead("_r").over(w).alias("_next"), F.lead(order).over(w).alias("_at")).filter("_c").join(last, F.col(key).eqNullSafe(F.col("_key")))
    state = F.when(F.col("_next"), "done").when(F.col("_next").isNotNull(), "replaced").when(F.col("run") < F.col("_last"), "expired").otherwise("pending")
    return x.select(key, F.col("run").cast("bigint").alias("run"), item, F.col(order).alias("called_at"), F.when(F.col("_next"), F.col("_at")).alias("result_at"), state.alias("state"))
