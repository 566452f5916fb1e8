"""N-gram Jaccard join by rare-first prefix filtering.

A document is the set of its distinct word n-grams; documents with equal sets are one class. N-grams are ordered rarest
first, by document counts over the whole corpus held in a table of fixed size (each n-gram is counted with those that
share its cell, so an order always exists and only its sharpness depends on the table). Two sets that reach the
similarity share an n-gram within their prefixes; classes are joined on those, cut down by the length, positional and
suffix filters, and each remaining pair is verified once, on whole sets.

The suffix filter deals the hash range into PARTS parts: two sets differ in at least as many n-grams as there are parts
where one count is odd and the other even.

Large groups of near copies are not expanded into all pairs. Rounds pair the classes that share a prefix n-gram with a few
leaders only: first those whose shared n-gram stands earliest in the prefix (they have the fewest n-grams of their own, so
they are nearest to what a group was copied from), then others. The last round joins the classes that are still in
different components, with all filters in the join's condition. Every link between classes of different components is
found there, so components are exact.

Edge cases: a document without words or text has no n-grams and no links. With fewer words than n, the whole sequence is
its one n-gram. A null doc_id takes part but is never a component's id unless all of it are null. Rows that repeat a
doc_id give a result row each. Other columns are ignored, whatever their names.

N-grams are known by 64-bit hashes, classes by 120 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm import counting, textvec
from tracegrain.llm.graph import components
from tracegrain.llm.scratch import dropped, written

#: Cells of the table of document counts, and how many are summed in one row.
CELLS, BLOCK = 1 << 22, 1 << 16
#: Rounds of pairing with leaders at most, leaders of an n-gram in a round, and steps of components between rounds.
ROUNDS, LEADERS, STEPS = 6, 2, 3
#: A round that adds less than this part of the first one's links is followed by the last round.
FEW = 0.02
#: Parts of the hash range whose parities the suffix filter compares, and the 64-bit words that hold them.
PARTS = 1024
SKETCH = [f"k{i}" for i in range(PARTS // 64)]


def _sets(batch: pa.RecordBatch, n: int):
    """Sorted distinct n-gram hashes of each row of a batch."""
    data, offsets = textvec.utf8(batch.column("text"))
    data = textvec.lower_ascii(data)
    starts, ends, rows = textvec.words(data, offsets)
    hashes = textvec.word_hashes(data, starts, ends)
    grams, at = textvec.shingle_hashes(hashes, rows, n)
    words = np.searchsorted(rows, np.arange(batch.num_rows + 1))
    cuts = np.searchsorted(at, words)
    for i in range(batch.num_rows):
        a, b = words[i], words[i + 1]
        if b - a >= n:
            yield np.unique(grams[cuts[i] : cuts[i + 1]])
        elif b > a:
            short, _ = textvec.shingle_hashes(hashes[a:b], rows[a:b], b - a)
            yield textvec.mix(short ^ np.uint64(b - a))
        else:
            yield grams[:0]


def _cells(n: int):
    """For mapInArrow: document counts of a task's n-grams by cell, as rows of BLOCK counts."""

    def run(batches):
        counts = np.zeros(CELLS, np.int32)
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            for own in _sets(batch, n):
                cells, times = np.unique((own % np.uint64(CELLS)).astype(np.int64), return_counts=True)
                counts[cells] += times
        blocks = counts.reshape(-1, BLOCK)
        yield counting.batch({int(i): blocks[i] for i in np.flatnonzero(blocks.any(axis=1))})

    return textvec.lean(run)


def document_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Document counts of all n-grams by cell: CELLS numbers, whatever the corpus."""
    counts = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for block, data in counting.summed(docs.select("text").mapInArrow(_cells(n), "block int, counts binary")).collect():
        counts[block] = counting.unpacked(bytes(data))
    return counts.reshape(-1)


def _codes(counts: np.ndarray) -> np.ndarray:
    """Document counts in a byte each: themselves below 128, then four steps to a doubling. Any monotone code gives an order of n-grams."""
    large = 128 + np.floor(4 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(large, 255)).astype(np.uint8)


def _least_shared(size, percent: int):
    """n-grams that a set of that size shares at least with any that reaches the similarity."""
    return -(-size * percent // 100)


def _sketches(sets: list[np.ndarray]) -> list[pa.Array]:
    """Parities of the sets' counts in PARTS parts of the hash range, as columns of 64-bit words."""
    odd = np.zeros((len(sets), PARTS), np.uint8)
    for i, own in enumerate(sets):
        odd[i] = np.bincount((own >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS) & 1
    words = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
    return [pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(SKETCH))]


def _prefixes(n: int, percent: int, counts: pa.Buffer):
    """For mapInArrow: class, size, sketch and rare-first prefix of each document."""

    def run(batches):
        table = np.frombuffer(counts, np.uint8)
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            sets = list(_sets(batch, n))
            prefixes = []
            for own in sets:
                order = np.argsort(table[(own % np.uint64(CELLS)).astype(np.int64)], kind="stable")
                prefixes.append(own[order[: len(own) - _least_shared(len(own), percent) + 1 if len(own) else 0]].view(np.int64))
            columns = [batch.column("doc_id"), batch.column("row"), textvec.digests(sets), pa.array([len(x) for x in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), *_sketches(sets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "size", "prefix", *SKETCH])

    return textvec.lean(run)


def _whole_sets(n: int):
    """For mapInArrow: class and n-gram hashes of each document."""

    def run(batches):
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            sets = list(_sets(batch, n))
            yield pa.RecordBatch.from_arrays([textvec.digests(sets), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "grams"])

    return textvec.lean(run)


def _needed(percent: int) -> Column:
    """n-grams that sets of sizes size_a and size_b must share."""
    total = F.col("size_a") + F.col("size_b")
    return F.ceil((total * percent) / F.lit(100.0 + percent) - 1e-9)


def _sided(df: DataFrame, side: str, *names: str) -> DataFrame:
    """df with its node as `side` and its other columns, but for those named, with that suffix."""
    return df.select(*(F.col(c).alias(side if c == "node" else c if c in names else f"{c}_{side}") for c in df.columns))


class _Join:
    """One run of the join over the documents' n-gram sets."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.percent = n, percent
        self.docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
        counts = _codes(document_counts(self.docs, n))
        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, row bigint, node decimal(38,0), size bigint, prefix array<bigint>, " + ", ".join(f"{k} bigint" for k in SKETCH)
        self.table = written(self.docs.mapInArrow(_prefixes(n, percent, counts.tobytes()), schema), "prefixes")
        # equal sets have equal prefixes, so any row stands for its class
        repeats = self.table.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
        self.repeats = written(repeats, "repeats")
        self.repeated = not self.repeats.isEmpty()
        self.classes = self.table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def shared(self) -> DataFrame:
        """Postings of prefix n-grams that more than one class has: gram, node, size, place, more.

        more is false where only two documents have the n-gram: the first round pairs those two, and nothing is left.


        What a pair shares first stands so early in the smaller set that what follows could be all that they must share
        at equal sizes; an n-gram that stands so early in no set is left out.
        """
        rows = self.table.filter("node is not null").select("node", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("place", "gram"))
        class_of = F.xxhash64("node")  # of half the width of a node, and enough to tell that there are two
        early = F.col("size") - F.col("place") >= F.ceil(F.col("size") * (2 * self.percent) / F.lit(100.0 + self.percent) - 1e-9)
        common = rows.groupBy("gram").agg(F.min(class_of).alias("least"), F.max(class_of).alias("most"), F.bool_or(early).alias("early"), (F.count("*") > 2).alias("more")).filter("early and least < most").select("gram", "more")
        return written(rows.join(common, "gram").distinct(), "postings")

    def _fits(self) -> Column:
        """Length filter, and the positional filter of one shared n-gram."""
        least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        bound = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        return (least * 100 >= most * self.percent) & (bound >= _needed(self.percent))

    def _suffix_fits(self) -> Column:
        """Suffix filter: the sets differ at least by the parts with different parities."""
        apart = functools.reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH))
        return F.col("size_a") + F.col("size_b") - apart >= 2 * _needed(self.percent)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), of a written table, whose whole sets reach the similarity."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        rows = written(self.rows.join(wanted, "node", "left_semi").select("row"), "rows")
        texts = self.docs.join(rows, "row", "left_semi")
        if self.repeated:  # rows of equal id and text stand for one class once
            more = self.docs.join(rows.join(self.repeats, "row", "left_semi"), "row", "left_semi").dropDuplicates(["row"])
            texts = texts.join(self.repeats, "row", "left_anti").unionByName(more)
        sets = written(texts.select("text").mapInArrow(_whole_sets(self.n), "node decimal(38,0), grams array<bigint>"), "sets")
        both = pairs.join(_sided(sets, "a"), "a").join(_sided(sets, "b"), "b")
        shared = F.size(F.array_intersect("grams_a", "grams_b"))
        return written(both.filter(shared * (100 + self.percent) >= (F.size("grams_a") + F.size("grams_b")) * self.percent).select("a", "b").distinct(), "links", rows, sets)

    def components(self) -> DataFrame:
        """node, component of every class that is linked with another."""
        postings = self.shared()
        self.rows = written(self.table.join(postings.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"), *(F.min(k).alias(k) for k in SKETCH)), "classes")
        links, tested, old = [], [], []
        left, more = postings.withColumn("component", F.col("node")), postings.filter("more")
        for r in range(ROUNDS):
            tested.append(self._untested(self._led(left, r), tested))
            links.append(self.verified(tested[-1]))
            if r and links[-1].count() <= FEW * links[0].count():  # leaders help no more
                break
            known = components(_all(links).toDF("u", "v"), STEPS, settle=False)
            # a node's later labels may be coarser or finer, but what was connected stays so
            labelled = (left.drop("component") if r else more).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = labelled.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("gram")
            left = written(labelled.join(mixed, "gram", "left_semi"), "postings", *old)
            old = [known, left]
        full = left.drop("more").join(self.rows.drop("row"), "node")
        apart = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
        found = _sided(full, "a", "gram").join(_sided(full, "b", "gram"), "gram").filter(apart & self._fits() & self._suffix_fits()).select("a", "b")
        tested.append(self._untested(found.distinct(), tested))
        links.append(self.verified(tested[-1]))
        out = components(_all(links).toDF("u", "v"))
        for table in (postings, self.rows, *old, *tested, *links):
            dropped(table)
        return out

    def _untested(self, pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
        """The pairs (a, b) without those that a round has verified before, written."""
        pairs = pairs.select("a", "b")
        return written(pairs.join(_all(tested), ["a", "b"], "left_anti") if tested else pairs, "pairs")

    def _led(self, postings: DataFrame, r: int) -> DataFrame:
        """Pairs (a, b) of classes with the leaders of their n-grams, out of another component, that pass the filters.

        The first leader of an n-gram in the first round is the class where it stands earliest in the prefix. All others
        are the least of its classes by a hash of the class and the round, so n-grams of much the same classes have the
        same leaders.
        """
        postings = postings.drop("more")
        least = [F.min(F.struct((F.lit(0) if seed else F.col("place")).alias("first"), F.xxhash64("node", F.lit(seed)).alias("h"), "node", "size", "place", "component")) for seed in range(r * LEADERS, (r + 1) * LEADERS)]
        leaders = postings.groupBy("gram").agg(F.array_distinct(F.array(*(F.struct(*(x[c].alias(c) for c in ("node", "size", "place", "component"))) for x in least))).alias("x"))
        leaders = leaders.select("gram", F.explode("x").alias("x")).select("gram", "x.*")
        found = _sided(leaders, "a", "gram").join(_sided(postings, "b", "gram"), "gram").filter((F.col("component_a") != F.col("component_b")) & self._fits())
        turned = F.col("a") > F.col("b")
        size = lambda x, y: F.when(turned, F.col(f"size_{x}")).otherwise(F.col(f"size_{y}"))
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), size("b", "a").alias("size_a"), size("a", "b").alias("size_b")).distinct()
        rows = self.rows.drop("row")
        return pairs.join(_sided(rows, "a"), "a").join(_sided(rows, "b"), "b").filter(self._suffix_fits())


def _all(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id), one row for each row of docs.

    Documents link when 100 * shared n-grams >= percent * all their n-grams; component_id is the least doc_id that
    links reach. doc_id may be of any type that has an order.
    """
    join = _Join(docs, n, percent)
    found = join.components()
    labels = join.classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(least, "component").select("node", "component_id")
    rows = join.table.select("doc_id", F.col("size").alias("n_shingles"), "node")
    return rows.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("bigint")))
