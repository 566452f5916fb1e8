"""Toxicity behind a noisy channel.

A writer's letters pass a channel that swaps them for look-alikes, stretches them and puts signs or spaces between them.
Each suspect token becomes a lattice of the letters that its characters may stand for; a Viterbi search under a character
trigram model, counted over the whole corpus, restores the likeliest word. A token without look-alikes, doubled letters or
inner signs has one path only, so it stands as it is; a doubled letter is one of the paths, so the model decides.
Look-alikes that end sentences or open brackets (! and parenthesis) do not end a token.

The restored text is scored by words whose share among toxic training documents is significantly larger; the sum of their
log odds is turned into a probability by the labels of the training documents with about that sum.

Learnt from at most `train_rows` labelled documents, the first by a hash of doc_id, and of their words from the
`candidates` most frequent in toxic ones; character counts cover all documents.

Edge cases: null and empty texts have no words and get the share of toxic documents among those without telling words.
Without labels to learn from the score is 0. Null ids are not held out and not learnt from; repeated rows get a result row
each; of contradicting labels of one doc_id the larger counts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm import counting, textvec

#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Log costs of the channel: a look-alike, a dropped sign, a dropped repetition of three or more, one of two, a dropped
#: look-alike. The last two weigh against the letter that the model need not explain then.
SWAPPED, DROPPED, STRETCHED, DOUBLED, SKIPPED = -0.7, -0.4, -0.1, -5.5, -10.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the character model: a to z, any other letter, and the space at a word's ends.
SYMBOLS, REST, EDGE = 28, 26, 27
LIKE, LAST = r"0-9@$!|+(€£¡", r"0-9@$|+€£"
SUSPECT = re.compile(
    # each lookahead over a run is asked for at the run's first place only, so that long runs take linear time
    rf"(?<![a-z])(?<![^a-z][{LIKE}])(?<!\A[{LIKE}])(?=[{LIKE}]*+[a-z])[a-z]*+(?=[{LIKE}.*_\-])[a-z{LIKE}.*_\-]*[a-z{LAST}]"
    r"|(?<![a-z])[a-z]*([a-z])\1[a-z]*"
    rf"|(?<![a-z0-9])(?<![^a-z0-9][{LIKE}][ .\-_*])(?<!\A[{LIKE}][ .\-_*])(?=(?:[{LIKE}][ .\-_*])*+[a-z])[a-z{LIKE}](?:[ .\-_*][a-z{LIKE}])+[ .\-_*][a-z{LAST}](?![a-z0-9])"
)
MEMORY = 200_000
#: Bins of summed log odds: below 0 (no telling word), then in steps of a quarter.
BINS, STEP = 66, 0.25


@functools.cache
def _word_bytes() -> np.ndarray:
    """Lower-case ASCII letters and the bytes of other characters; a space for all else."""
    table = np.full(256, 0x20, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


@functools.cache
def _symbols() -> np.ndarray:
    table = np.full(256, EDGE, np.int64)
    table[97:123] = np.arange(26)
    table[128:] = REST
    return table


def _trigram_counts(batches):
    """For mapInArrow: counts of the character trigrams of a task's texts."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in textvec.slices(batches, "text"):
        data, offsets = textvec.utf8(batch.column("text"))
        # continuation bytes are part of the letter before them; a space after every text
        values = _symbols()[_word_bytes()[data]]
        keep = (data & 0xC0) != 0x80
        values = np.insert(values[keep], np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[offsets], EDGE)
        codes = (values[:-2] * SYMBOLS + values[1:-1]) * SYMBOLS + values[2:]
        counts += np.bincount(codes, minlength=SYMBOLS**3)
    yield counting.batch({0: counts})


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of each symbol after each two, add-one smoothed, over all texts."""
    rows = counting.summed(docs.select("text").mapInArrow(_trigram_counts, "block int, counts binary")).collect()
    counts = (counting.unpacked(bytes(rows[0][1])) if rows else np.zeros(SYMBOLS**3)).reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 1.0
    return np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


class Restorer:
    """Viterbi search over the letters that a token's characters may stand for."""

    def __init__(self, model: np.ndarray):
        self.model, self.memory = model.tolist(), {}

    def restored(self, token: str) -> str:
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            found = self.memory[token] = self._search(token)
        return found

    def _search(self, token: str) -> str:
        model = self.model
        # state: the last two symbols, and whether the last may still be stretched; value: log probability, letters
        states = {(EDGE, EDGE): (0.0, "")}
        before = ""
        for i, c in enumerate(token):
            new: dict = {}
            again = c == before
            dropped = DOUBLED if again and (i < 2 or token[i - 2] != c) and token[i + 1 : i + 2] != c else STRETCHED
            for (a, b), (value, letters) in states.items():
                ways = []
                if "a" <= c <= "z":
                    ways.append((c, 0.0))
                    if again:
                        ways.append(("", dropped))
                elif c in LOOKALIKES:
                    ways += [(x, 0.0 if again else SWAPPED) for x in LOOKALIKES[c]]
                    ways.append(("", SKIPPED))
                    if again:
                        ways.append(("", dropped))
                else:
                    ways.append(("", DROPPED))
                for letter, cost in ways:
                    if letter:
                        s = ord(letter) - 97
                        key, total, text = (b, s), value + cost + model[a][b][s], letters + letter
                    else:
                        key, total, text = (a, b), value + cost, letters
                    if key not in new or total > new[key][0]:
                        new[key] = (total, text)
            states, before = new, c
        return max((value + model[a][b][EDGE], letters) for (a, b), (value, letters) in states.items())[1]

    def extra(self, text: str) -> str:
        """What the suspect tokens of a text stand for; empty if there are none."""
        small = text.lower()
        return " ".join(word for m in SUSPECT.finditer(small) if (word := self.restored(m[0])) != m[0])


_restorers: dict[bytes, Restorer] = {}


def _restorer(model: bytes) -> Restorer:
    if model not in _restorers:
        _restorers.clear()
        _restorers[model] = Restorer(np.frombuffer(model, np.float32).reshape(SYMBOLS, SYMBOLS, SYMBOLS))
    return _restorers[model]


def features(texts: pa.Array, model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the words of each text, as written and as restored; each word once a row."""
    extra = pa.array([_restorer(model).extra(t) if t else "" for t in texts.to_pylist()], pa.string())
    hashes, rows = [], []
    for column in (texts, extra):
        data, offsets = textvec.utf8(column)
        data = _word_bytes()[data]
        starts, ends, row = textvec.words(data, offsets)
        hashes.append(textvec.word_hashes(data, starts, ends))
        rows.append(row)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


class _Labels:
    """Training ids and labels, sorted by id."""

    def __init__(self, rows: list):
        rows = sorted(rows)
        self.ids, self.toxic = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)

    def of(self, ids: pa.Array) -> np.ndarray:
        """1, 0, or -1 for ids that are not learnt from."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        return np.where((self.ids[at] == own) & ids.is_valid().to_numpy(zero_copy_only=False), self.toxic[at], -1)


def _labelled(batches, labels: _Labels):
    for batch in textvec.slices(batches, "text"):
        own = labels.of(batch.column("doc_id"))
        keep = np.flatnonzero(own >= 0)
        if len(keep):
            yield batch.column("text").take(pa.array(keep)), own[keep]


def _toxic_words(labels: _Labels, model: bytes):
    """For mapInArrow: (word, n) of the toxic training documents of a task."""

    def run(batches):
        held: list = []
        for texts, toxic in _labelled(batches, labels):
            chosen = np.flatnonzero(toxic == 1)
            if len(chosen):
                held.append(features(texts.take(pa.array(chosen)), model)[0])
            if sum(map(len, held)) > 1 << 20:
                words, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])
                held = []
        if held:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return run


def _places(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted words, or -1."""
    if not len(words):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def _word_counts(labels: _Labels, model: bytes, words: np.ndarray):
    """For mapInArrow: for each label, the documents that hold each word, and all documents."""

    def run(batches):
        counts = np.zeros((2, len(words) + 1), np.int64)
        for texts, toxic in _labelled(batches, labels):
            hashes, rows = features(texts, model)
            at = _places(words, hashes)
            for label in (0, 1):
                counts[label, :-1] += np.bincount(at[(at >= 0) & (toxic[rows] == label)], minlength=len(words))
                counts[label, -1] += (toxic == label).sum()
        yield counting.batch({0: counts[0], 1: counts[1]})

    return run


class Model:
    """Character model, telling words with their log odds, and the probability of each bin of sums."""

    def __init__(self, characters: bytes, words: np.ndarray, odds: np.ndarray, chances: np.ndarray):
        self.characters, self.words, self.odds, self.chances = characters, words, odds, chances

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Summed log odds of each text's telling words; -1 without one."""
        hashes, rows = features(texts, self.characters)
        at = _places(self.words, hashes)
        rows, at = rows[at >= 0], at[at >= 0]
        total = np.bincount(rows, self.odds[at], len(texts)) if len(rows) else np.zeros(len(texts))
        return np.where(np.bincount(rows, minlength=len(texts)) > 0, total, -1.0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.chances[_bins(self.sums(texts))]


def _bins(sums: np.ndarray) -> np.ndarray:
    return np.where(sums < 0, 0, np.clip((sums / STEP).astype(np.int64) + 1, 1, BINS - 1))


def _bin_counts(labels: _Labels, model: Model):
    def run(batches):
        counts = np.zeros((2, BINS), np.int64)
        for texts, toxic in _labelled(batches, labels):
            np.add.at(counts, (toxic, _bins(model.sums(texts))), 1)
        yield counting.batch({0: counts[0], 1: counts[1]})

    return run


def _both(df: DataFrame, size: int) -> np.ndarray:
    counts = np.zeros((2, size), np.int64)
    for block, data in counting.summed(df).collect():
        counts[block] = counting.unpacked(bytes(data))
    return counts


def _rising(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Shares that never fall, by pooling neighbours; a bin without rows takes the share before it."""
    pools: list[list[float]] = []
    for g, n in zip(good.tolist(), all_.tolist(), strict=True):
        pools.append([g, n, 1])
        while len(pools) > 1 and (not pools[-1][1] or pools[-2][1] and pools[-1][0] * pools[-2][1] <= pools[-2][0] * pools[-1][1]):
            g, n, m = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + n, pools[-1][2] + m]
    return np.concatenate([np.full(int(m), g / n if n else 0.0) for g, n, m in pools])


def _root_ratio(with_: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Root of the likelihood ratio of each word's documents by label against one share for both: about a normal deviate."""
    share = with_.sum(axis=0) / all_.sum()
    total = np.zeros(with_.shape[1])
    for label in (0, 1):
        for seen, expected in ((with_[label], all_[label] * share), (all_[label] - with_[label], all_[label] * (1 - share))):
            total += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)
    return np.sqrt(np.maximum(total, 0))


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = 100_000, candidates: int = 65_536, least_z: float = 5.0, least_odds: float = 0.7) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic: the rows to learn from).

    A word tells if its log odds are at least least_odds and its share differs between the labels by least_z deviations.
    """
    characters = character_model(docs).tobytes()
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()
    known = _Labels([tuple(r) for r in rows])
    nothing = Model(characters, np.zeros(0, np.uint64), np.zeros(0), np.zeros(BINS))
    if not len(known.ids):
        return nothing
    frequent = docs.mapInArrow(_toxic_words(known, characters), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "word").limit(candidates).collect()
    words = np.sort(np.array([r[0] for r in frequent], np.int64).view(np.uint64))
    counts = _both(docs.mapInArrow(_word_counts(known, characters, words), "block int, counts binary"), len(words) + 1)
    with_, all_ = counts[:, :-1] + 0.5, counts[:, -1:] + 1.0
    odds = np.log(with_[1] / all_[1]) - np.log(with_[0] / all_[0])
    telling = (odds >= least_odds) & (_root_ratio(counts[:, :-1], counts[:, -1:]) >= least_z)
    model = Model(characters, words[telling], odds[telling], np.zeros(BINS))
    counts = _both(docs.mapInArrow(_bin_counts(known, model), "block int, counts binary"), BINS)
    model.chances = _rising(counts[1], counts.sum(axis=0))
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs (with a text column) and the probability that each text is toxic."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [model.scores(batch.column(0)) for batch in textvec.slices([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, F.arrow_udf(run, "double")("text"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("bigint").alias("toxic"))
    model = trained(docs, labels.filter(is_training(F.col("doc_id"))))
    held_out = F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
