"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.scratch import dropped, written


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stepped(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: greater neighbours move to the least neighbour
    large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # small star: lesser neighbours and the node itself move to the least
    low = _least(large)
    return large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    """What tells whether a step changed the edges: their number and a sum of 128 bits over them."""
    whole = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), whole(1), whole(2)).first())


def components(edges: DataFrame, steps: int = 60, settle: bool = True) -> DataFrame:
    """edges (u, v) to (node, component): the least node that can be reached. Nodes without an edge are not returned.

    Every step is joins and partial minima on (node, node) rows, so no component meets in one task. The number of rows
    never grows: each edge becomes at most one edge. Self-loops and repeated edges are harmless; null ends are dropped.

    settle=False ends after `steps` steps: nodes of equal component are connected, but not all connected ones are equal.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table, known = None, None
    for _ in range(steps):
        new = written(_stepped(edges if table is None else table), "edges", *([] if table is None else [table]))
        table = new
        if settle:
            now = _sum(new)
            if now == known:
                break
            known = now
    else:
        if settle:
            raise RuntimeError(f"components not settled after {steps} steps")
    labels = table.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return written(labels.unionByName(table.select(F.col("v").alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))), "components", table)
