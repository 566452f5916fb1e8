"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams, in order. A document is given the language
whose profile is nearest to the document's own list by out-of-place distance: the sum over the document's n-grams of how
far each stands from its place in the profile, with the profile's length for n-grams that it lacks.

Profiles are counted over every labelled training row; only the finished profiles, `profile` n-grams for each language,
reach the driver and the tasks. Letters are lower-cased; runs of other characters count as one space.

Edge cases: a text that is null, empty or without a letter is `und` with score 0; so is every text if there is nothing to
learn from. Equal counts rank by n-gram, equal distances by language name. Null ids and repeated rows give a result row
each (a null doc_id is neither learnt from nor held out). Other columns are left as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm import textvec

UNKNOWN = "und"
SPACE = 0x20
#: Counted n-grams that a task holds before it sends them on.
HELD = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter; a space for what is no letter."""
    table = np.full(0x110000, SPACE, np.int64)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            small = c.lower()
            table[point] = ord(small) if len(small) == 1 else point
    return table


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters with single spaces before, between and after words, for all rows of a slice; offsets of the rows."""
    return textvec.folded(column, _letters())[:2]


def grams(letters: np.ndarray, order: int) -> list[np.ndarray]:
    """Packed n-grams of 1 to `order` letters at each place of one row; a space alone is none."""
    found = [letters[letters != SPACE]]
    code = letters
    for n in range(1, order):
        code = (code[:-1] << 21) | letters[n:]
        found.append(code)
    return found


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, in order."""
    own, counts = np.unique(codes, return_counts=True)
    if len(own) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        own, counts = own[counts >= least], counts[counts >= least]
    return own[np.argsort(-counts, kind="stable")[:most]]


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _merged(held: dict[str, list]) -> dict[str, list]:
    out = {}
    for lang, pairs in held.items():
        codes, counts = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        own, which = np.unique(codes, return_inverse=True)
        out[lang] = [(own, np.bincount(which, counts, len(own)).astype(np.int64))]
    return out


def _count(order: int):
    """For mapInArrow: lang, gram, n over all rows of a task."""

    def rows(held: dict[str, list]):
        for lang, [(codes, counts)] in _merged(held).items():
            for at in range(0, len(codes), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(counts[part])], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            letters, at = normalised(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                parts = [g for i in np.flatnonzero(langs == lang) for g in grams(letters[at[i] : at[i + 1]], order)]
                own, counts = np.unique(np.concatenate(parts), return_counts=True)
                held.setdefault(lang, []).append((own, counts))
                size += len(own)
            if size > HELD:
                held = _merged(held)
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from rows(held)
                    held, size = {}, 0
        if held:
            yield from rows(held)

    return textvec.lean(run)


def profiles(labelled: DataFrame, order: int = 3, profile: int = 400, most_languages: int = 1000) -> dict[str, np.ndarray]:
    """Ordered n-grams of each language in labelled (text, lang); rows without either are skipped.

    What reaches the driver is bounded by profile * most_languages codes; more languages are refused, not dropped.
    """
    counts = labelled.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(_count(order), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))
    # the top of each part of a language first, then the top of those, so that no task gets a whole language
    top = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("r", best("lang", "part")).filter(F.col("r") <= profile)
    top = top.withColumn("r", best("lang")).filter(F.col("r") <= profile).select("lang", "gram", "r")
    rows = top.limit(profile * most_languages + 1).collect()
    if len(rows) > profile * most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    found: dict[str, list] = {}
    for lang, gram, r in sorted(rows):
        found.setdefault(lang, []).append((r, gram))
    return {lang: np.array([g for _, g in sorted(pairs)], np.int64) for lang, pairs in sorted(found.items())}


def _predictor(known: dict[str, np.ndarray], order: int, profile: int):
    tables = [(lang, np.sort(codes), np.argsort(codes)) for lang, codes in known.items()]

    def distance(own: np.ndarray, codes: np.ndarray, places: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        return int(np.where(codes[at] == own, np.abs(places[at] - np.arange(len(own))), profile).sum())

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores = [], []
            for batch in textvec.slices([pa.RecordBatch.from_arrays([column], ["text"])], "text", textvec.SMALL_SLICE):
                letters, at = normalised(batch.column(0))
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    lang, score = UNKNOWN, 0.0
                    if hi - lo > 1 and tables:
                        own = ranked(np.concatenate(grams(letters[lo:hi], order)), profile)
                        d, lang = min((distance(own, codes, places), lang) for lang, codes, places in tables)
                        score = 1 - d / (len(own) * profile)
                    langs.append(lang)
                    scores.append(max(0.0, score))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return textvec.lean(run)


def identified(docs: DataFrame, known: dict[str, np.ndarray], order: int = 3, profile: int = 400, name: str = "language") -> DataFrame:
    """docs (with a text column) and a struct column of lang_pred and score (1 less the distance as a share of the largest)."""
    return docs.withColumn(name, F.arrow_udf(_predictor(known, order, profile), "lang_pred string, score double")("text"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    known = profiles(docs.filter(is_training(F.col("doc_id"))))
    held_out = F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    return identified(docs.select("doc_id", "text"), known).select("doc_id", held_out, "language.lang_pred", "language.score")
