"""Quality by importance resampling.

Two generative models of hashed word n-grams (words and word pairs, lower-cased, in a fixed number of cells) are counted:
one of target text, one of all raw text. A document's log weight is the sum over its n-grams of the log ratio of the
two, and the sample is the k documents of largest log weight plus Gumbel noise, which draws without replacement in
proportion to the weights. The noise is a function of doc_id and the seed, so a run can be repeated.

The raw model is counted over every document. The target model is counted over at most `target_rows` labelled documents,
the first by a hash of doc_id; that bound is the only sample taken.

Edge cases: a null or empty text has log weight 0. A null doc_id has the noise of its own constant hash; rows that repeat a
doc_id share its noise, and a result row each. Rows whose key equals the k-th largest are all selected. Without target
rows every weight is 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm import counting, textvec
from tracegrain.llm.scratch import written

CELLS = 1 << 14
RAW, TARGET = 0, 1


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each word and word pair of the rows of a slice, and the row of each."""
    data, offsets = textvec.utf8(column)
    data = textvec.lower_ascii(data)
    starts, ends, rows = textvec.words(data, offsets)
    hashes = textvec.word_hashes(data, starts, ends)
    pairs, at = textvec.shingle_hashes(hashes, rows, 2)
    both = np.concatenate((hashes, pairs))
    return (both >> np.uint64(64 - 14)).astype(np.int64), np.concatenate((rows, rows[at]))


def _counter(targets: np.ndarray):
    """For mapInArrow: the counts of a task's documents, raw and target."""

    def run(batches):
        totals = np.zeros((2, CELLS), np.int64)
        for batch in textvec.slices(batches, "text"):
            cells, rows = _cells(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            chosen = np.isin(ids, targets)
            totals[RAW] += np.bincount(cells, minlength=CELLS)
            totals[TARGET] += np.bincount(cells[chosen[rows]], minlength=CELLS)
        yield counting.batch({RAW: totals[RAW], TARGET: totals[TARGET]})

    return run


def log_ratios(docs: DataFrame, targets: DataFrame, target_rows: int) -> np.ndarray:
    """The log ratio of the target model to the raw model in each cell, add-one smoothed."""
    first = targets.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    ids = np.array([r[0] for r in first.collect()], np.int64)
    counts = np.zeros((2, CELLS))
    for block, data in counting.summed(docs.select("doc_id", "text").mapInArrow(_counter(ids), "block int, counts binary")).collect():
        counts[block] = counting.unpacked(bytes(data))
    if not counts[TARGET].sum():
        return np.zeros(CELLS)
    shares = (counts + 1) / (counts.sum(axis=1, keepdims=True) + CELLS)
    return np.log(shares[TARGET]) - np.log(shares[RAW])


def _weigher(ratios: np.ndarray):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = []
            for batch in textvec.slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
                cells, rows = _cells(batch.column(0))
                parts.append(np.bincount(rows, ratios[cells], batch.num_rows))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id: of a uniform number strictly between 0 and 1, from 53 bits of its hash."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the doubles in column `key`, by counts in ever narrower cells; 65,536 counts reach the driver each time."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or low == high or k <= 0:
        return math.inf if k <= 0 or high is None else low
    cells = 1 << 16
    while True:
        # equal cells between low and high; the k-th largest is in the first cell, from above, that reaches k
        width = (high - low) / cells
        if width == 0 or low + width == low or high - width == high:
            rows = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("key")).limit(cells).collect()
            for key, n in rows:
                k -= n
                if k <= 0:
                    return key
            raise ArithmeticError("keys too close together")
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(cells - 1)).alias("place")
        rows = inside.groupBy(place).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("place")).collect()
        for _, n, lower, upper in rows:
            if n >= k:
                low, high = lower, upper
                break
            k -= n
        if low == high:
            return low


def resampled(docs: DataFrame, targets: DataFrame, share: float = 0.8, target_rows: int = 50_000, seed: int = 17) -> DataFrame:
    """docs (doc_id, text), targets (doc_id) to (doc_id, log_weight, key, selected): the `share` of rows that is drawn."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ratios = log_ratios(docs, targets.select(F.col("doc_id").cast("bigint").alias("doc_id")), target_rows)
    weight = F.arrow_udf(_weigher(ratios), "double")("text")
    scored = docs.select("doc_id", weight.alias("log_weight")).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "weights")
    least = kth_largest(scored.select("key"), math.ceil(scored.count() * share))
    return scored.withColumn("selected", F.col("key") >= F.lit(least))


def op1_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return resampled(docs, labels.filter("quality = 1"))
