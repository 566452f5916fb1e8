"""Closest names: the n names most alike to each query, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.windows import ratio


def _tokens(rows: DataFrame, name: str) -> DataFrame:
    """name, size, token: its characters, each with how often it stood in the name before."""
    chars = F.split(F.col(name), "")
    x = rows.select(name, F.char_length(name).alias("size"), F.posexplode(chars).alias("_i", "_c")).filter("_c <> ''")
    nth = F.row_number().over(Window.partitionBy(name, "_c").orderBy("_i"))
    return x.select(name, "size", F.concat("_c", nth.cast("string")).alias("token"))


def closest(queries: DataFrame, names: DataFrame, query: str, name: str, n: int = 5, cutoff: float = 0.5) -> DataFrame:
    """Each query's n most similar names of at least the cutoff: query, name, score, place; the greater name first among equals.

    The similarity is at most twice the shared characters over all characters. So names are posted under their rarest
    characters only, as many as any name that reaches the cutoff must meet; pairs that meet and whose lengths and shared
    characters allow it are compared.
    """
    asked = queries.select(F.col(query).alias("q")).filter("q <> ''").distinct()
    known = names.select(F.col(name).alias("x")).filter("x <> ''").distinct()
    left, right = _tokens(asked, "q"), _tokens(known, "x")
    common = right.groupBy("token").agg(F.count("*").alias("df"))  # a row for each character and place
    least = F.ceil(F.col("size") * (cutoff / (2 - cutoff)) - 1e-9)  # characters shared with the shortest name that can reach the cutoff
    prefix = lambda t, key: (
        t.join(common, "token", "left").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "token"))).filter(F.col("_r") <= F.col("size") - least + 1).select(key, "token", F.col("size").alias(f"size_{key}"))
    )
    fits = F.least("size_q", "size_x") * (2 - cutoff) >= F.greatest("size_q", "size_x") * cutoff - 1e-9
    pairs = prefix(left, "q").join(prefix(right, "x"), "token").filter(fits).select("q", "x", "size_q", "size_x").distinct()
    counts = lambda c: F.transform(F.array_sort(F.array_distinct(F.split(c, ""))), lambda k: F.struct(k.alias("k"), (F.char_length(c) - F.char_length(F.replace(c, k, F.lit("")))).alias("n")))
    own = F.map_from_entries(F.filter(counts(F.col("x")), lambda e: e["k"] != ""))
    shared = F.aggregate(F.filter(counts(F.col("q")), lambda e: e["k"] != ""), F.lit(0), lambda s, e: s + F.least(e["n"], F.coalesce(F.try_element_at(own, e["k"]), F.lit(0))))
    pairs = pairs.filter(shared * 2 >= (F.col("size_q") + F.col("size_x")) * cutoff - 1e-9)
    scored = pairs.withColumn("score", ratio(F.col("q"), F.col("x"))).filter(F.col("score") >= cutoff)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("x")))
    return scored.withColumn("place", place).filter(F.col("place") <= n).select(F.col("q").alias(query), F.col("x").alias(name), "score", "place")

