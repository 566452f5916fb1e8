"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

The postings of the items' terms are written by term, each term in a fixed number of blocks of documents, with what its
weight is multiplied by. Then, for all items at once:

1. the heads of every list (its `k` best postings) give each document found in them a lower bound, which is raised to the
   whole score for the best `deep` * k of an item. A part of the k-th best, dealt evenly over the item's lists, is its
   threshold: a document below the threshold in every list cannot be among the k best;
2. every list gives all postings at or above the item's threshold. They are added up in blocks of documents and items, and a
   document goes whose upper bound (the threshold, or the list's best where that is less, for each list that has not named it)
   is below the k-th best lower bound;
3. what is left is looked up in all lists of its item and ranked by its whole score.

Scores are integers, so bounds and results are exact. Ties go to the smaller doc_id, and bounds keep ties. Terms are known
by 64-bit hashes. Tasks that read documents drop terms outside a bit map of the items' terms, and the last phase drops
documents outside a set of cells of candidates; both have a fixed size and only save work.

Edge cases: a null or empty text has no terms and does not count as a document. Rows that repeat a doc_id are documents of
their own, with a rank each. A null doc_id stands last among equal scores. Rows that repeat an item_id are one item, with
the terms of all; a null item_id is an item as well. Items without terms, or whose terms no document holds, have no
result; neither have empty tables. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm import textvec
from tracegrain.llm.scratch import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blocks of documents that a term's postings are split into.
BLOCKS = 32
#: Bits of the map of the items' terms, and cells of candidate documents.
BITS, CELLS = 1 << 22, 1 << 17
#: The threshold is this part of the least that rules out documents of which no list names anything: more are named, and bounds are closer.
PART = 8
#: Documents and items of a block in the second phase, about.
DOCUMENTS, ITEMS = 4096, 256


def _table() -> np.ndarray:
    """Bytes with A-Z lower-cased and all that no term holds as a space."""
    table = np.full(256, 0x20, np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = np.arange(low, high)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def _terms(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = textvec.utf8(column)
    data = table[data]
    return data, *textvec.words(data, offsets)


def _sizes(batches):
    """For mapInArrow: how many of a task's documents have terms, and how many terms they have."""
    table, number, every = _table(), 0, 0
    for batch in textvec.slices(batches, "text"):
        _, starts, _, rows = _terms(batch.column("text"), table)
        number, every = number + len(np.unique(rows)), every + len(starts)
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([every])], ["number", "every"])


def _hashed(keys: list[str], bits: bytes | None):
    """For mapInArrow: the keys of each row, its terms n, and hash and count of each distinct term that the bit map has."""

    def run(batches):
        table, known = _table(), None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in textvec.slices(batches, "text"):
            data, starts, ends, rows = _terms(batch.column("text"), table)
            sizes = np.bincount(rows, minlength=batch.num_rows)
            hashes = textvec.word_hashes(data, starts, ends)
            if known is not None:
                held = known[(hashes >> np.uint64(42)).astype(np.int64)]
                hashes, rows = hashes[held], rows[held]
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            new = np.ones(len(rows), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            at = np.flatnonzero(new)
            row = pa.array(rows[at])
            columns = [*(batch.column(k).take(row) for k in keys), pa.array(sizes[rows[at]]), pa.array(hashes[at].view(np.int64)), pa.array(np.diff(np.append(at, len(rows))))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n", "h", "tf"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) to q (the id as text), item_id, h (the term): once each."""
    item = F.col("item_id").cast("bigint")
    rows = items.select(F.coalesce(item.cast("string"), F.lit("")).alias("q"), item.alias("item_id"), "text")
    return rows.mapInArrow(_hashed(["q", "item_id"], None), "q string, item_id bigint, n bigint, h bigint, tf bigint").select("q", "item_id", "h").distinct()


def best(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; first within parts of it, so a large group is not sorted in one task."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(BLOCKS))).withColumn("r", first(group, "part")).filter(F.col("r") <= k)
    return some.withColumn("r", first(group)).filter(F.col("r") <= k).drop("part", "r")


def postings(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text), wanted (h) to the written postings (h, row, doc_id, f) and the lists' weights (h, w, top, documents: their number).

    A term adds w * f to the score of its document; top is the most that it adds to any.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    number, every = docs.select("text").mapInArrow(_sizes, "number bigint, every bigint").agg(F.coalesce(F.sum("number"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    bits = np.zeros(BITS, bool)
    bits[[r[0] for r in wanted.select(F.shiftrightunsigned("h", 42)).distinct().collect()]] = True  # at most BITS numbers
    counts = docs.mapInArrow(_hashed(["row", "doc_id"], np.packbits(bits).tobytes()), "row bigint, doc_id bigint, n bigint, h bigint, tf bigint")
    m = F.expr(f"10 + (90 * n * {number}L) div {max(every, 1)}L")
    factor = F.expr("int((1000000000L * tf) div (1000 * tf + 8 * m))")
    # Spark broadcasts the terms where their size allows, else it shuffles
    lists = counts.join(wanted, "h", "left_semi").withColumn("m", m).select("h", "row", "doc_id", factor.alias("f"))
    lists = written(lists.repartition("h", F.pmod(F.xxhash64("row"), F.lit(BLOCKS))).sortWithinPartitions("h", F.desc("f")), "postings")
    weight = F.floor(1000 * F.log((F.lit(2.0) * number + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weights = lists.groupBy("h").agg(F.count("*").alias("df"), F.max("f").alias("most")).withColumn("w", weight).select("h", "w", (F.col("w") * F.col("most")).alias("top"), F.lit(number).alias("documents"))
    return lists, written(weights.filter("top > 0"), "weights")


def _kth(bounds: DataFrame, k: int, value: str) -> DataFrame:
    """The k-th best lower bound of each item: q, least; items with fewer documents have none."""
    leading = best(bounds, "q", k, F.desc(value), F.asc("row"))
    return leading.groupBy("q").agg(F.min(value).alias("least"), F.count("*").alias("n")).filter(F.col("n") == k).select("q", "least")


def _scores(left: DataFrame, lists: DataFrame, known: DataFrame) -> DataFrame:
    """left (q, row), written, to their whole scores: q, row, doc_id, score."""
    cell = F.pmod(F.xxhash64("row"), F.lit(CELLS))
    cells = left.select(cell.alias("cell")).distinct()
    near = lists.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi").drop("cell")  # at most CELLS numbers
    found = left.join(near, "row").join(known.select("q", "h", "w"), ["q", "h"])
    return found.groupBy("q", "row", "doc_id").agg(F.sum(F.col("w") * F.col("f")).alias("score"))


def _bounded(postings: pa.Table, limits: pa.Table) -> pa.Table:
    """For cogrouped applyInArrow: lower and upper bounds of a block of documents for a block of items, where these may be among the best."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    if postings.num_rows and limits.num_rows:
        h, row, f = (postings.column(c).to_numpy() for c in ("h", "row", "f"))
        order = np.lexsort((-f, h))
        h, f = h[order], f[order].astype(np.int64)
        rows, at = np.unique(row[order], return_inverse=True)
        limits = limits.sort_by("i")
        item, wanted, w, rest, least_f, least = (limits.column(c).to_numpy() for c in ("i", "h", "w", "rest", "from", "least"))
        items, first = np.unique(item, return_index=True)
        begin, end = np.searchsorted(h, wanted), np.searchsorted(h, wanted, "right")
        found = []
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(item)], strict=True)):
            lower, missing = np.zeros(len(rows), np.int64), np.full(len(rows), rest[a:b].sum())
            for j in range(a, b):
                # a list's postings stand by falling f
                n = begin[j] + np.searchsorted(-f[begin[j] : end[j]], -least_f[j], "right")
                lower[at[begin[j] : n]] += w[j] * f[begin[j] : n]
                missing[at[begin[j] : n]] -= rest[j]
            kept = np.flatnonzero((lower > 0) & (lower + missing >= least[a]))
            found.append((np.full(len(kept), items[i]), rows[kept], lower[kept], lower[kept] + missing[kept]))
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
    return pa.table(out, ["i", "row", "lower", "upper"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, deep: int = 4) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) to item_id, rank, doc_id, score: each item's k best documents."""
    asked = written(item_terms(items), "terms")
    names = written(asked.select("q", "item_id").distinct().withColumn("i", F.monotonically_increasing_id()), "items")
    asked = asked.join(names.select("q", "i"), "q").select(F.col("i").alias("q"), "h")
    lists, weights = postings(docs, asked.select("h").distinct())
    known = written(asked.join(weights, "h"), "lists")  # each item's lists that add anything
    # phase 1: lower bounds from the heads, and a threshold for each item
    heads = best(lists.select("h", "row", "f"), "h", k, F.desc("f"), F.asc("row"))
    bounds = known.join(heads, "h").groupBy("q", "row").agg(F.sum(F.col("w") * F.col("f")).alias("lower"))
    leading = written(best(bounds, "q", deep * k, F.desc("lower"), F.asc("row")).select("q", "row"), "leading")
    least = written(_kth(_scores(leading, lists, known), k, "score"), "least")
    sizes = known.groupBy("q").agg(F.count("*").alias("lists")).join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    limits = known.join(sizes, "q").withColumn("limit", F.expr(f"(least + {PART} * lists - 1) div ({PART} * lists)"))
    # rest: the most that a list adds to what it does not name; from: the least f that it names
    limits = limits.select("q", "h", "w", F.least("top", F.col("limit") - 1).alias("rest"), F.expr("(limit + w - 1) div w").alias("from"), "least", F.pmod(F.xxhash64("q"), F.lit(-(-max(1, names.count()) // ITEMS))).alias("part"))
    limits = written(limits, "limits")
    # phase 2: all postings from the threshold on, and the documents that they leave
    blocks = max(1, -(-known.agg(F.max("documents")).first()[0] // DOCUMENTS)) if not known.isEmpty() else 1
    reached = lists.join(limits.groupBy("h", "part").agg(F.min("from").alias("from")), "h").filter(F.col("f") >= F.col("from"))
    reached = reached.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "part", "h", "row", "f")
    whole = limits.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).select("block", "part", F.col("q").alias("i"), "h", "w", "rest", "from", "least")
    named = reached.toDF(*reached.columns).groupBy("block", "part").cogroup(whole.toDF(*whole.columns).groupBy("block", "part")).applyInArrow(_bounded, "i bigint, row bigint, lower bigint, upper bigint")
    named = written(named.withColumnRenamed("i", "q"), "named")
    least = least.unionByName(_kth(named, k, "lower")).groupBy("q").agg(F.max("least").alias("least"))
    left = written(named.join(least, "q", "left").filter(F.col("upper") >= F.coalesce("least", F.lit(0))).select("q", "row"), "candidates", named)
    # phase 3: the whole scores of what is left
    top = best(_scores(left, lists, known), "q", k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return top.withColumn("rank", rank).join(names.select(F.col("i").alias("q"), "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return ranked(docs, items)


OP11_SQL = rf"""
WITH split AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
sums AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM split WHERE len(t) > 0),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark)),
counts AS MATERIALIZED (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM split) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM counts, sums GROUP BY term),
gains AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS gain FROM counts JOIN weights USING (term), sums),
scores AS (SELECT item_id, r, doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, r, doc_id HAVING sum(gain) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores) WHERE rank <= 10
"""
