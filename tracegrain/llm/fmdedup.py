"""Substring deduplication with a compressed FM-index in each shard.

A window is `window` consecutive words of one document; a word goes if a window that covers it has the same words as one
that starts earlier (smaller doc_id, or the same document and an earlier start). Documents of equal words are found by a
digest first: the later ones are all windows of the first.

The other documents are cut into segments of neighbouring windows that have the same anchor: their least word n-gram by a
hash order, very frequent ones last, at one place. Equal windows have equal anchors, so shards by anchor never miss a pair, and no
document has to visit a shard that cannot hold its windows. Equal segments are merged before they are sent. Each shard
builds a suffix array, its Burrows-Wheeler transform in a wavelet matrix with packed bits, and streams its segments
through backward search; as soon as a match is longer than a window it is cut back to the window's length, so every
window gets the interval of all its occurrences. Windows whose interval holds an earlier start are reported.

An anchor is in one shard. Segments of one that more than `shard` different segments have would fill it, so they are cut
into their windows instead, at most 15 each, and equal windows meet in a grouped aggregation, whose least start each is
held against. Such anchors are few (segments / `shard` at most) and are counted among the merged segments.

A task holds the arrays of a slice of 256 KB or of one shard, and its worker gives back what it freed.

Which anchors occur twice, and which documents are looked at, is kept in maps of `map_bits` bits at most; a wrong hit there
only costs a segment or a document that finds nothing. Texts are told apart by 256 bits, segments by 120, and words in the
index by 64.

Edge cases: a null or empty text has no words and keeps none (the digest of the empty string). A null doc_id comes after
all others. Different texts with one doc_id are ordered by their digest; rows that repeat id and words count as one
document and get a result row each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm import textvec
from tracegrain.llm.scratch import written

#: Words of an anchor, and segments of a shard; an anchor of more has none.
ANCHOR, SHARD = 6, 10_000
#: Anchors of more segments than this are frequent, and so many of the most frequent come last in the order.
FREQUENT, MOST_FREQUENT = 1000, 512
LAST = (1 << 63) - 1


def _words(batch: pa.RecordBatch):
    """Raw bytes, and start, end, row and hash of each word of a slice; first word of each row."""
    data, offsets = textvec.utf8(batch.column("text"))
    starts, ends, rows = textvec.words(data, offsets)
    hashes = textvec.word_hashes(data, starts, ends)
    return data, starts, ends, rows, hashes, np.searchsorted(rows, np.arange(batch.num_rows + 1))


def _digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), signed=True)


@textvec.lean
def _summaries(batches):
    """For mapInArrow: digest, word count and digest of all words of each document."""
    for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
        data, _, _, _, hashes, first = _words(batch)
        _, offsets = textvec.utf8(batch.column("text"))
        raw = data.tobytes()
        sequences = [_digest(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), pa.array(sequences, pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(whole)], ["doc_id", "doc", "seq", "n_words", "whole"])


def _kept(batches, places: bytes):
    """Slices of the documents that stand in the map of places."""
    bits = np.frombuffer(places, np.uint8)
    for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
        place = batch.column("doc").to_numpy(zero_copy_only=False) % (len(bits) * 8)
        keep = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1)
        if len(keep):
            yield batch.take(pa.array(keep)) if len(keep) < batch.num_rows else batch


def segments(hashes: np.ndarray, rows: np.ndarray, window: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, windows and anchor of each segment of a slice."""
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    grams, at = textvec.shingle_hashes(hashes, rows, ANCHOR)
    order = grams >> np.uint64(1)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)
        order = np.where(frequent[place] == order, order | np.uint64(1 << 63), order)
    value = np.full(n, np.iinfo(np.uint64).max)
    value[at] = order
    # place of the least n-gram of each window, the leftmost of equals, by doubling
    best, reach, wide = np.arange(n), window - ANCHOR + 1, 1

    def lesser(other: np.ndarray, shift: int) -> np.ndarray:
        right = np.append(other[shift:], np.full(shift, n - 1))
        return np.where(value[right] < value[best], right, best)

    while wide * 2 <= reach:
        best = lesser(best, wide)
        wide *= 2
    if wide < reach:
        best = lesser(best, reach - wide)
    start = np.flatnonzero(rows[window - 1 :] == rows[: n - window + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    where = best[start]
    anchor = value[where]
    # all windows of a segment hold the anchor at one place, so no two of them are equal
    new = np.ones(len(start), bool)
    new[1:] = where[1:] != where[:-1]
    first = np.flatnonzero(new)
    return start[first], np.diff(np.append(first, len(start))), anchor[first].view(np.int64)


def _anchors(window: int, frequent: np.ndarray, places: bytes):
    """For mapInArrow: anchors of a task's segments and how many have them."""

    @textvec.lean
    def run(batches):
        for batch in _kept(batches, places):
            _, _, _, rows, hashes, _ = _words(batch)
            own, n = np.unique(segments(hashes, rows, window, frequent)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _marked(values: np.ndarray, places: bytes) -> np.ndarray:
    """Which values stand in a map of places."""
    bits = np.frombuffer(places, np.uint8)
    place = values % (len(bits) * 8)
    return (bits[place >> 3] >> (place & 7)) & 1 == 1


def _occurrences(window: int, frequent: np.ndarray, places: bytes, repeated: bytes, whole: bool = False):
    """For mapInArrow: segments whose anchor may occur twice: digest, place, windows; `whole`: also anchor and words."""

    @textvec.lean
    def run(batches):
        for batch in _kept(batches, places):
            _, _, _, rows, hashes, first = _words(batch)
            start, count, anchor = segments(hashes, rows, window, frequent)
            keep = np.flatnonzero(_marked(anchor, repeated))
            start, count, anchor = start[keep], count[keep], anchor[keep]
            row = rows[start]
            sequences = {r: _digest(hashes[first[r] : first[r + 1]]) for r in np.unique(row).tolist()}
            ends = start + count + window - 1
            parts = [hashes[a:b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
            columns = [textvec.digests(parts), batch.column("doc").take(pa.array(row)), pa.array([sequences[r] for r in row.tolist()], pa.int64()), pa.array((start - first[row]).astype(np.int32)), pa.array(count.astype(np.int32))]
            names = ["seg", "doc", "seq", "at", "n"]
            if whole:
                columns += [pa.array(anchor), pa.array([x.tobytes() for x in parts], pa.binary())]
                names += ["anchor", "words"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


class Bits:
    """A bit vector with counts of the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.zeros = len(bits) - int(bits.sum())
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes().ljust(-(-(len(bits) + 1) // 64) * 8, b"\0"), np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class FMIndex:
    """Suffixes of a text of word numbers (0 separates segments), sorted by their first 32 words, and backward search.

    Patterns are windows of 20 words at most 32 long; the intervals of such patterns do not depend on how suffixes that
    agree in 32 words are ordered.
    """

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        self.text, self.window = text, window
        rank, ranks, step = np.unique(text, return_inverse=True)[1].astype(np.int32), {}, 1
        while step < 32:
            ranks[step] = rank
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            after += rank * np.int64(n + 2)
            rank = np.unique(after, return_inverse=True)[1].astype(np.int32)
            step *= 2
        self.order = np.argsort(rank, kind="stable").astype(np.int32)
        # suffixes with the same first `window` words form a block: compare ranks of power-of-two lengths that cover it
        same = np.zeros(n, bool)
        same[1:] = True
        at, left = 0, window
        for size in (16, 8, 4, 2, 1):
            while left >= size:
                shifted = self.order + at
                value = np.where(shifted < n, ranks[size][np.minimum(shifted, n - 1)], -1)
                same[1:] &= value[1:] == value[:-1]
                at, left = at + size, left - size
        first = np.flatnonzero(~same)
        self.block = np.cumsum(~same, dtype=np.int32) - 1
        self.block_start, self.block_end = first, np.append(first[1:], n)
        self.before = np.searchsorted(np.sort(text), np.arange(int(text.max()) + 2))
        values = text[self.order - 1]
        self.levels: list[Bits] = []
        start = np.zeros(int(text.max()) + 1, np.int64)
        symbols = np.arange(len(start))
        for level in range(int(text.max()).bit_length() - 1, -1, -1):
            bit = (values >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        for level, bits in zip(range(len(self.levels) - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(start)
            start = np.where((symbols >> level) & 1, bits.zeros + ones, start - ones)
        self.start = start

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        both = np.concatenate((low, high))
        symbols = np.concatenate((symbol, symbol))
        for level, bits in zip(range(len(self.levels) - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(both)
            both = np.where((symbols >> level) & 1, bits.zeros + ones, both - ones)
        both += self.before[symbols] - self.start[symbols]
        return both[: len(low)], both[len(low) :]

    def windows(self, ends: np.ndarray, sizes: np.ndarray):
        """Blocks of all windows of the segments text[end - size : end]: yields places and blocks, from right to left."""
        by = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[by], sizes[by]
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text))
        for t in range(int(sizes.max(initial=0))):
            active = int(np.searchsorted(-sizes, -t, "left"))
            place = ends[:active] - 1 - t
            low, high = self.step(self.text[place], low[:active], high[:active])
            if t >= self.window:  # a match of window + 1 words: back to its first `window`
                block = self.block[low]
                low, high = self.block_start[block], self.block_end[block]
            if t >= self.window - 1:
                yield place, self.block[low]


def _earlier(table: pa.Table, window: int) -> pa.Table:
    """Segments of a shard with the windows that have an earlier occurrence in it."""
    data, cuts = textvec.utf8(table.column("words").combine_chunks())
    sizes = np.diff(cuts) // 8
    begin = np.cumsum(sizes + 1) - sizes - 1
    segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    offset = (np.arange(len(segment)) - begin[segment]).astype(np.int32)
    text = np.zeros(len(segment), np.int32)
    text[offset < sizes[segment]] = np.unique(data.view(np.uint64), return_inverse=True)[1] + 1
    doc, seq, at = (table.column(c).to_numpy() for c in ("doc", "seq", "at"))
    # a number for each document, in their order, and the place in it: windows of equal words start at different ones
    by = np.lexsort((seq, doc))
    new = np.zeros(len(by), np.int64)
    new[1:] = (doc[by[1:]] != doc[by[:-1]]) | (seq[by[1:]] != seq[by[:-1]])
    base = np.empty(len(by), np.int64)
    base[by] = np.cumsum(new) << 32
    start = (base + at)[segment] + offset
    index = FMIndex(text, window)
    earliest = np.minimum.reduceat(start[index.order], index.block_start)
    found = [place[earliest[block] < start[place]] for place, block in index.windows(begin + sizes, sizes)]
    found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    own, cut = np.unique(segment[found], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(found)).astype(np.int32)), pa.array(offset[found]))
    return pa.table([table.column("seg").take(pa.array(own)), lists], ["seg", "earlier"])


def _searched(window: int):
    """For applyInArrow: `_earlier` of a shard, after which the worker keeps no freed memory."""

    def run(table: pa.Table) -> pa.Table:
        found = _earlier(table, window)
        textvec.release()
        return found

    return run


def _texts(places: bytes):
    """For mapInArrow: documents in the map of places, with their digests."""

    @textvec.lean
    def run(batches):
        for batch in _kept(batches, places):
            _, _, _, _, hashes, first = _words(batch)
            sequences = [_digest(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sequences, pa.int64()), batch.column("text")], ["doc", "seq", "text"])

    return run


def _removed(window: int):
    """For mapInArrow: what is left of each text without the words of the windows that start at `starts`."""

    @textvec.lean
    def run(batches):
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            data, starts, ends, _, _, first = _words(batch)
            raw, counts, digests = data.tobytes(), [], []
            for i, windows in enumerate(batch.column("starts").to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, np.array(windows), 1)
                np.add.at(cover, np.array(windows) + window, -1)
                keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                counts.append(b - a - len(keep))
                digests.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("seq"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc", "seq", "removed", "left"])

    return run


def _earlier_windows(segments: DataFrame, window: int) -> DataFrame:
    """seg and the windows of segments (seg, doc, seq, at, words) that start earlier elsewhere, without a shard: equal windows are grouped."""
    n = (F.octet_length("words") / 8).cast("int") - window
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr("words", i * 8 + 1, F.lit(8 * window)))
    x = segments.select("seg", "doc", "seq", "at", F.posexplode(cut).alias("i", "window")).withColumn("start", F.struct("doc", "seq", F.col("at") + F.col("i")))
    # written, so that Spark can split what a very common window fills in the join
    least = written(x.groupBy("window").agg(F.min("start").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "windows")
    return x.join(least, "window").filter(F.col("least") < F.col("start")).groupBy("seg").agg(F.sort_array(F.collect_list("i")).alias("earlier"))


def _map(values: DataFrame, name: str, n: int, most: int) -> bytes:
    """A bit for the place of each of n values, among 16 places for each value, but at most `most`."""
    bits = min(most, max(1 << 20, 1 << (16 * max(1, n) - 1).bit_length()))
    place = F.pmod(name, F.lit(bits)) + 1
    rows = values.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect()
    found = bytearray(bits // 8)
    for k, data in rows:
        found[(k - 1) * 4096 : k * 4096] = data
    return bytes(found)


def deduplicated(docs: DataFrame, window: int = 20, map_bits: int = 1 << 28, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_removed, kept_sha256 for each row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), "text")
    rows = written(docs.mapInArrow(_summaries, "doc_id bigint, doc bigint, seq bigint, n_words bigint, whole string"), "documents")
    firsts = rows.groupBy("whole").agg(F.min("doc").alias("first"))
    places = _map(firsts, "first", rows.count(), map_bits)
    texts = docs.select("doc", "text")

    def counted(frequent: np.ndarray) -> DataFrame:
        parts = texts.mapInArrow(_anchors(window, frequent, places), "anchor bigint, n bigint")
        return parts.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")

    counts = written(counted(np.zeros(0, np.uint64)), "anchors")
    top = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "anchor").limit(MOST_FREQUENT).collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    if len(frequent):
        counts = written(counted(frequent), "anchors")
    repeated = _map(counts, "anchor", counts.count(), map_bits)
    place = "seg decimal(38,0), doc bigint, seq bigint, at int, n int"
    with_words = texts.mapInArrow(_occurrences(window, frequent, places, repeated, whole=True), place + ", anchor bigint, words binary")
    known = with_words.groupBy("seg").agg(F.min(F.struct("doc", "seq", "at")).alias("x"), *(F.first(c).alias(c) for c in ("anchor", "words")))
    known = written(known.select("seg", "x.*", "anchor", "words"), "segments")
    shards = max(1, -(-known.count() // shard))
    # written, as the size of its few rows lets Spark send them to the segments
    crowded = written(known.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > shard).select("anchor"), "crowded")
    n_crowded = crowded.count()
    rest = known.join(crowded, "anchor", "left_anti") if n_crowded else known
    found = rest.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_searched(window), "seg decimal(38,0), earlier array<int>")
    found = found.unionByName(_earlier_windows(known.join(crowded, "anchor", "left_semi"), window)) if n_crowded else found
    # written, so that the join below is of two shuffles, of which Spark can split what a very common segment fills
    found = written(known.select("seg", F.struct("doc", "seq", "at").alias("first")).join(written(found, "found"), "seg", "left"), "found")
    occurrences = texts.mapInArrow(_occurrences(window, frequent, places, repeated), place).join(found, "seg")
    all_windows = F.sequence(F.lit(0), F.col("n") - 1)
    offsets = F.when(F.struct("doc", "seq", "at") == F.col("first"), F.coalesce("earlier", F.array().cast("array<int>"))).otherwise(all_windows)
    removed = occurrences.withColumn("starts", F.transform(offsets, lambda x: x + F.col("at"))).filter(F.size("starts") > 0).groupBy("doc", "seq").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    removed = written(removed, "removed")
    some = texts.mapInArrow(_texts(_map(removed, "doc", removed.count(), map_bits)), "doc bigint, seq bigint, text string")
    left = some.join(removed, ["doc", "seq"]).mapInArrow(_removed(window), "doc bigint, seq bigint, removed bigint, left string").dropDuplicates(["doc", "seq"])
    out = rows.join(firsts, "whole").join(written(left, "left"), ["doc", "seq"], "left")
    copied = (F.col("doc") != F.col("first")) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("left", "whole")).alias("kept_sha256"),
    )


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
