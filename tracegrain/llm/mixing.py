"""Mixing sources to target weights by a low-discrepancy source schedule.

Sources in code point order (null last) have weights that repeat, and share the words of all documents by weight; a target
stops at `most` times its source's size, and what is left over is shared again by weight until no target is above that.

Each source's documents, shuffled by a digest of id and text, are laid end to end and cut into blocks of equally many words
(the last one may be shorter). The slots of the mix are the points of a golden-ratio sequence, taken through the cumulative
numbers of blocks that the sources need: a slot belongs to the source whose stretch its point falls into. The n-th slot of
a source takes the source's n-th block, and begins again with the first once all were taken. Slots beyond what a source needs are left out, and what
the points leave short (a few slots a source) is appended, so each source gives its target, rounded to whole words.

All of it is DataFrame functions. No task holds a source: offsets are summed within buckets of the shuffled order, and
slots are ranked within chunks of the schedule; only the sums of buckets and chunks run through one window for each
source. The sources themselves, a row each, pass one task.

Edge cases: a null or empty text has size 0 and nothing is taken of it. A null source is a source of its own, as is an
empty name. Null and repeated ids are rows of their own; rows that agree in id, source and text are taken in any order, which changes no
result. Without words all targets are 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK = 256
#: Points of the schedule lie on a grid of 2**31; this step is the golden ratio's part of it.
GRID, STEP = 1 << 31, 1327217885
#: Cells of the grid on which points meet sources, and slots of a chunk.
CELLS, CHUNK = 4096, 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) to doc_id, absent and name (the source), key (the shuffled order) and size."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    size = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("name"), key.alias("key"), size.alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """Of each source: its number s, source_size, target, and take, the words that the mix takes of it."""
    sources = rows.groupBy("absent", "name").agg(F.sum("size").alias("source_size"))
    together = Window.partitionBy(F.lit(0))
    number = F.row_number().over(together.orderBy("absent", "name")) - 1
    sources = sources.withColumn("s", number).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1).cast("bigint"))
    whole = lambda c: c.cast("decimal(38,0)")
    # from the source that is full first: full, if its part of what those before leave is at least what it may give
    once = math.lcm(*weights)
    sources = sources.withColumn("limit", F.col("source_size") * most).withColumn("total", F.floor(F.sum("source_size").over(together) * F.lit(share)))
    before = together.orderBy(F.col("limit") * F.expr(f"{once} div weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    gone, gone_weight = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("limit", "weight"))
    sources = sources.withColumn("left", F.col("total") - gone).withColumn("left_weight", F.sum("weight").over(together) - gone_weight)
    full = whole(F.col("limit")) * whole(F.col("left_weight")) <= whole(F.col("left")) * whole(F.col("weight"))
    sources = sources.withColumn("full", full)
    rest = lambda c: F.sum(F.when(~F.col("full"), F.col(c)).otherwise(0)).over(together)
    given = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(together)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(given.cast("double") * F.col("weight") / rest("weight"))
    return sources.withColumn("target", target).select("absent", "name", "s", "source_size", "target", F.floor(F.col("target") + 0.5).alias("take"))



def needs(sources: DataFrame) -> DataFrame:
    """sources with blocks, whole (epochs taken as a whole), rest (words of the last one) and need, the slots."""
    whole = F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0))
    out = sources.withColumn("blocks", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}")).withColumn("whole", whole).withColumn("rest", F.expr("take - whole * source_size"))
    return out.withColumn("need", F.expr(f"whole * blocks + (rest + {BLOCK - 1}) div {BLOCK}"))


def schedule(sources: DataFrame) -> DataFrame:
    """The slots of the mix: slot (its place), s, rank (within the source), epoch, block, words (the most it takes of the block)."""
    known = written(needs(sources), "sources")
    slots = known.agg(F.sum("need")).first()[0] or 0
    cut = lambda c: F.floor(F.col(c) / F.lit(float(max(slots, 1))) * GRID)
    until = F.sum("need").over(Window.partitionBy(F.lit(0)).orderBy("s"))
    stretch = known.withColumn("until", until).withColumn("since", F.col("until") - F.col("need")).filter("need > 0").select("s", cut("since").alias("low"), cut("until").alias("high")).filter("low < high")
    cell = GRID // CELLS
    stretch = stretch.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))))
    point = F.expr(f"((id + 1) % {GRID}) * {STEP} % {GRID}")
    points = sources.sparkSession.range(slots).withColumn("point", point).withColumn("cell", F.expr(f"point div {cell}"))
    drawn = points.join(stretch, "cell").filter("point >= low and point < high").select(F.col("id").alias("slot"), "s", F.expr(f"id div {CHUNK}").alias("chunk"))
    counts = drawn.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("s", "chunk", "before")
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("within", within).join(before, ["s", "chunk"]).select("slot", "s", (F.col("before") + F.col("within")).alias("rank"))
    reached = known.join(counts.groupBy("s").agg(F.sum("n").alias("n")), "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < need")
    short = reached.select("s", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).alias("slot"), "s", "rank")
    of = known.select("s", "blocks", "whole", "rest", "need")
    taken = ranked.unionByName(short).join(of, "s").filter("rank < need").withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    last = F.least(F.lit(BLOCK), F.expr(f"rest - block * {BLOCK}"))
    return taken.select("slot", "s", "rank", "epoch", "block", F.when(F.col("epoch") < F.col("whole"), F.lit(BLOCK)).otherwise(last).cast("bigint").alias("words"))


def laid(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words: doc_id, s, size and start, the place of their first word in the source's shuffled order."""
    rows = rows.filter("size > 0").join(sources.select("absent", "name", "s"), ["absent", "name"]).withColumn("bucket", F.substring("key", 1, 4))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("s", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("within", within).join(before, ["s", "bucket"]).select("doc_id", "s", "size", (F.col("before") + F.col("within")).alias("start"))


def mixed(documents: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix, to be ordered by slot and start: slot, s, epoch, doc_id, start (of its document), size, from_word and to_word of the document.

    A piece of a block that no slot takes has one row without a slot; what lies behind a source's last word is an empty piece.
    """
    pieces = documents.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))))
    first = F.greatest(F.lit(0), F.expr(f"block * {BLOCK} - start"))
    last = F.least("size", F.expr(f"block * {BLOCK} + coalesce(words, 0) - start"))
    return pieces.join(slots, ["s", "block"], "left").select("slot", "s", "epoch", "doc_id", "start", "size", first.alias("from_word"), F.greatest(first, last).alias("to_word"))


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    rows = written(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    sources = written(targets(rows), "targets")
    mix = mixed(laid(rows, sources), schedule(sources))
    # no two documents with words of a source start at one place
    taken = mix.groupBy("s", "start", "doc_id", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    some = taken.join(sources, "s").select("doc_id", "size", "source_size", "target", "taken")
    none = rows.filter("size = 0").join(sources, ["absent", "name"]).select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none)


#: The words taken follow from targets and the shuffled order alone: whole epochs, and the part of a document in the last one.
OP12_SQL = r"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][s % 3 + 1] AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
ordered AS (SELECT *, total - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w FROM weighed
  WINDOW before AS (ORDER BY cap * (10 // w), s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, cap * rest_w <= rest * w AS is_full FROM ordered),
aimed AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM judged),
taking AS (SELECT *, floor(target + 0.5)::BIGINT AS take FROM aimed),
placed AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM sized)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (take // source_size) * size + greatest(0, least(size, take % source_size - start)) END::BIGINT AS taken
FROM placed JOIN taking ON placed.source IS NOT DISTINCT FROM taking.source
"""
