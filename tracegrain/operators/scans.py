"""Ordered scans without a task that holds a whole group: running sums and extremes, as-of joins, overlaps, exact ranks.

Rows are dealt out by ranges of (keys, order), so a hot key spans many blocks, and written with the number of their block.
A scan runs within each block; the blocks' totals, a row for each block and key, are scanned over the blocks and carried into
them. Rows that agree in keys and order stay in one block: give an order that tells rows apart.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracegrain.tables import written

#: How a scan takes in a value, and how what came before is carried into a block.
TOTAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
CARRIED = {
    "sum": lambda own, before: F.when(own.isNull() & before.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))),
    "count": lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)),
    "max": F.greatest, "min": F.least, "last": F.coalesce,
}
ENDS = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
BLOCK = "_scan_block"


def blocked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows written in ranges of keys and order, with the number of the range."""
    dealt = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in [*keys, *order]))
    return written(dealt.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def scanned(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """rows with a column for each name=(kind, value, inclusive): the scan of the value over the key's rows up to this one.

    kind: sum, count, max, min or last (not null). inclusive: whether the row itself counts. Null keys are a key.
    """
    rows = rows.select("*", *(value.alias(f"_scan_v_{name}") for name, (_, value, _) in values.items()))
    rows = blocked(rows, keys, order)
    by = [F.col(c).asc_nulls_first() for c in order]
    block = Window.partitionBy(*keys, BLOCK).orderBy(*by)
    ends = rows.groupBy(*keys, BLOCK).agg(*((F.max_by(f"_scan_v_{n}", F.when(F.col(f"_scan_v_{n}").isNotNull(), F.struct(*order))) if kind == "last" else TOTAL[kind](f"_scan_v_{n}")).alias(f"_scan_t_{n}") for n, (kind, _, _) in values.items()))
    # a key has a row for each block that it reaches into
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*(F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)), F.col(BLOCK).alias("_scan_b"), *(ENDS[kind](f"_scan_t_{n}").over(earlier).alias(f"_scan_c_{n}") for n, (kind, _, _) in values.items()))
    for n, (kind, _, inclusive) in values.items():
        rows = rows.withColumn(f"_scan_o_{n}", TOTAL[kind](f"_scan_v_{n}").over(block.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    same = F.col(BLOCK) == F.col("_scan_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    joined = rows.join(before, same)
    names = [c for c in rows.columns if not c.startswith(("_scan_v_", "_scan_o_")) and c != BLOCK]
    return joined.select(*names, *(CARRIED[kind](F.col(f"_scan_o_{n}"), F.col(f"_scan_c_{n}")).alias(n) for n, (kind, _, _) in values.items()))


def with_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with right on equal keys, where null equals null."""
    if not keys:
        return left.join(right, F.lit(True), how)  # one row each
    other = right.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(other, same, how).drop(*(f"_r{i}" for i in range(len(keys))))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, take: dict[str, str], ties: str, within: Column | None = None) -> DataFrame:
    """left with the columns of the latest row of right at or before each row's time: take maps their names to right's columns.

    Of right rows of one time the one with the greatest `ties` counts. within: what the match must fulfil (over left's
    columns and take's names), else its columns are null; it judges the latest row only. Both sides are merged into one order and scanned, so no time range
    is compared in pairs.
    """
    columns = left.columns
    match = F.struct(*(F.col(c).alias(n) for n, c in take.items()))
    kind = right.select(match.alias("x")).schema["x"].dataType
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[ties].dataType).alias("_tie"), F.struct(*(F.col(c) for c in columns)).alias("_row"), F.lit(None).cast(kind).alias("_match"))
    none = F.lit(None).cast(a.schema["_row"].dataType)
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(ties).alias("_tie"), none.alias("_row"), match.alias("_match"))
    merged = a.unionByName(b).withColumn("_id", F.xxhash64("_row", "_tie"))
    found = scanned(merged, keys, ["_t", "_side", "_tie", "_id"], {"_found": ("last", F.col("_match"), True)}).filter("_side = 1")
    out = found.select("_row.*", *(F.col(f"_found.{n}").alias(n) for n in take))
    return out if within is None else out.select(*columns, *(F.when(within, F.col(n)).alias(n) for n in take))


def _swept(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Points of rows with the innermost interval of their group that holds them, and how many of the group do: keep, _found, _depth.

    rows: by, _t, _side (0: an interval ends, 1: one begins, 2: a point), _start, _end, _name and keep. Groups are streamed in order of time
    with a stack of the intervals that may still be innermost somewhere: one that began earlier and ends no later never is.
    """
    kind = rows.select("_start", "_end", "_name").schema
    schema = StructType([*rows.select(*keep).schema.fields, StructField("_found", kind), StructField("_depth", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_now, depth = None, [], 0
        for batch in batches:
            of = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
            found, depths = [], []
            for own, t, side, start, end, name in zip(zip(*map(of, by), strict=True), *map(of, ("_t", "_side", "_start", "_end", "_name")), strict=True):
                if own != group:
                    group, open_now, depth = own, [], 0
                if side == 0:
                    depth -= 1
                elif side == 1:
                    depth += 1
                    while open_now and open_now[-1][1] <= end:
                        open_now.pop()
                    open_now.append((start, end, name))
                else:
                    while open_now and open_now[-1][1] <= t:
                        open_now.pop()
                    found.append(dict(zip(("_start", "_end", "_name"), open_now[-1], strict=True)) if open_now else None)
                    depths.append(depth)
            here = batch.filter(pc.equal(batch.column("_side"), 2)).select(keep)
            kinds = pa.struct([batch.schema.field(c) for c in ("_start", "_end", "_name")])
            yield pa.RecordBatch.from_arrays([*here.columns, pa.array(found, kinds), pa.array(depths, pa.int64())], [*keep, "_found", "_depth"])

    # among equal starts the shorter, then the lesser name, comes last and lies on top
    return rows.repartition(*by).sortWithinPartitions(*by, "_t", "_side", F.desc("_end"), F.desc("_name")).mapInArrow(run, schema)


#: Points that are looked up together in the intervals of an earlier block.
TOGETHER = 1 << 16


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """Of each point the interval around it (start <= at < end) that began last (the shorter, then the lesser name, among equals): point, name, depth.

    depth counts all around it; points without one have no row. No pair of point and interval is made: a sweep over blocks of time finds
    what began in the point's block, and counts give the depth. Where that is above 0 and nothing is found, the answer lies in the last
    earlier block that has an interval reaching past the point, and is swept for there, in parts where many points ask.
    """
    known = functools.reduce(lambda x, k: x & F.col(k).isNotNull(), keys, F.lit(True))
    real = intervals.filter(known & (F.col(end) > F.col(start)))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    asked = points.filter(known & F.col(at).isNotNull()).select(*keys, F.col(at).alias("_t"), F.lit(2).alias("_side"), none(real, start).alias("_start"), none(real, end).alias("_end"), none(real, name).alias("_name"), F.col(point).alias("_point"))
    begun = real.select(*keys, F.col(start).alias("_t"), F.lit(1).alias("_side"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(name).alias("_name"), none(points, point).alias("_point"))
    ended = real.select(*keys, F.col(end).alias("_t"), F.lit(0).alias("_side"), *(none(begun, c).alias(c) for c in ("_start", "_end", "_name", "_point")))
    rows = blocked(asked.unionByName(begun).unionByName(ended), keys, ["_t"])
    # a row for each block that a key reaches into
    delta = F.when(F.col("_side") == 1, 1).when(F.col("_side") == 0, -1).otherwise(0)
    blocks = rows.groupBy(*keys, BLOCK).agg(F.sum(delta).alias("_d"), F.max("_end").alias("_reach"), F.min("_t").alias("_low"))
    before = F.coalesce(F.sum("_d").over(Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = blocks.select(*keys, BLOCK, before.alias("_base"))
    own = _swept(rows, [*keys, BLOCK], [*keys, BLOCK, "_point", "_t"])
    own = own.join(base, [*keys, BLOCK]).withColumn("_depth", F.col("_depth") + F.col("_base")).filter("_depth > 0").drop("_base")
    own = written(own, "swept")
    # of the blocks before one, nearest first, those that reach further than all nearer ones
    ladder = blocks.select(*keys, BLOCK, "_low").join(blocks.filter("_reach is not null").select(*keys, F.col(BLOCK).alias("_seek"), F.col("_reach")), keys).filter((F.col("_seek") < F.col(BLOCK)) & (F.col("_reach") > F.col("_low")))
    nearer = F.max("_reach").over(Window.partitionBy(*keys, BLOCK).orderBy(F.desc("_seek")).rowsBetween(Window.unboundedPreceding, -1))
    ladder = ladder.withColumn("_nearer", nearer).filter("_nearer is null or _reach > _nearer").drop("_low")
    far = own.filter("_found is null").drop("_found").join(ladder, [*keys, BLOCK]).filter("_t < _reach and (_nearer is null or _t >= _nearer)").select(*keys, "_seek", "_point", "_t", "_depth")
    parts = far.groupBy(*keys, "_seek").agg(F.ceil(F.count("*") / TOGETHER).alias("_parts"))
    far = far.join(parts, [*keys, "_seek"]).withColumn("_part", F.pmod(F.xxhash64("_point"), F.col("_parts"))).drop("_parts")
    held = rows.filter("_side = 1").withColumnRenamed(BLOCK, "_seek").join(parts, [*keys, "_seek"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts", "_point")
    again = far.withColumn("_side", F.lit(2)).withColumnRenamed("_depth", "_all").unionByName(held, allowMissingColumns=True)
    again = _swept(again, [*keys, "_seek", "_part"], [*keys, "_point", "_all"]).select(*keys, "_point", "_found", F.col("_all").alias("_depth"))
    found = own.filter("_found is not null").select(*keys, "_point", "_found", "_depth").unionByName(again)
    best = F.min_by("_found._name", F.struct(-F.col("_found._start"), F.col("_found._end"), F.col("_found._name")))
    return found.groupBy(*keys, F.col("_point").alias(point)).agg(best.alias(name), F.sum("_depth").alias("depth"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each key, interpolated between neighbours: keys, and a column for each name=share.

    Distinct values are counted first; their running counts over the sorted blocks give the ranks, and only the two values
    next to each rank that is asked for are kept. Null values do not count; a key without values has none.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    run = scanned(counted, keys, ["_x"], {"_upto": ("sum", F.col("_n"), True)})
    ranked = with_keys(run, counted.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys, "inner")
    inside = lambda r: (F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto"))
    places = {n: F.lit(share) * (F.col("_all") - 1) for n, share in shares.items()}
    held = [(n, F.floor(p), F.ceil(p), p) for n, p in places.items()]
    wanted = F.lit(False)
    for _, low, high, _ in held:
        wanted = wanted | inside(low) | inside(high)
    ends = ranked.filter(wanted).groupBy(*keys).agg(*(x for n, low, high, p in held for x in (F.max(F.when(inside(low), F.col("_x"))).alias(f"_l_{n}"), F.max(F.when(inside(high), F.col("_x"))).alias(f"_h_{n}"), F.max(p - low).alias(f"_p_{n}"))))
    return ends.select(*keys, *((F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_p_{n}")).alias(n) for n in shares))
