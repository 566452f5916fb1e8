"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item is cut into probes of `probe` characters that overlap by half, and into short ones of `short` characters
at a quarter of that. So every exact excerpt of 79 compared characters (short + short / 4 - 1), about 13 words, holds a whole
probe, wherever it begins; of an item that is shorter than that, the whole item is found. If a probe stands in a document with at
most k edits, the two share at least len + 1 - (k + 1) * q character q-grams (the q-gram lemma), all of them within k
neighbouring diagonals. So the q-grams of each document are counted in overlapping bands of diagonals; bands that reach
the bound are verified by banded alignment, which also gives the edits and the place.

Texts are compared in lower case, with every run of other characters than letters and digits as one space; spans are
code points of the document's own text.

The benchmark is taken in blocks of bounded size, each of which is sent to all tasks before the next is collected; documents are never shuffled.
Items of fewer characters than a probe are one probe, with as many fewer edits as the lemma's bound needs to stay above 0.

Edge cases: a null or empty document or item matches nothing, nor does an item of fewer than q + 1 compared characters.
Repeated rows give repeated results; items with equal texts give a result each. Null ids stay null. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm import textvec
from tracegrain.llm.scratch import written

#: Bits that choose a cell in the table of the benchmark's q-grams.
CELL_BITS = 22
#: More than any edit count.
FAR = 1 << 14


@functools.cache
def _characters() -> np.ndarray:
    """Each code point's lower-case letter or digit; a space for any other."""
    table = np.full(0x110000, 0x20, np.uint64)
    for point in range(0x110000):
        if (c := chr(point)).isalnum():
            small = c.lower()
            table[point] = ord(small) if len(small) == 1 else point
    return table


def _powers(q: int) -> list[int]:
    return [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(q)]


def qgrams(values: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q values."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, width, code = None, 1, values * np.uint64(0xFF51AFD7ED558CCD)
        done, rest = 0, q
        while rest:  # runs of 1, 2, 4 ... values are joined to runs of q
            if rest & 1:
                part = code[done : done + n] * np.uint64(_powers(q)[q - done - width])
                total = part if total is None else total + part
                done += width
            rest >>= 1
            if rest:
                code = code[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + code[width:]
                width *= 2
        return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Probes:
    """Probes of one block of the benchmark and an index of their q-grams."""

    items: list
    item: np.ndarray
    texts: list
    budget: np.ndarray
    bound: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    probe: np.ndarray
    offset: np.ndarray
    span: int

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """The first code of each cell, -1 where it has none."""
        cell, at = np.unique(self.codes >> np.uint64(64 - CELL_BITS), return_index=True)
        starts = np.full(1 << CELL_BITS, -1, np.int32)
        starts[cell.astype(np.int64)] = at
        return starts

    def __getstate__(self) -> dict:
        """Without the cells: each task makes its own, which is quicker than to send them and is held once."""
        return {k: v for k, v in self.__dict__.items() if k != "starts"}


#: Probes that need fewer shared q-grams than this are searched by themselves, lest they let everything through.
FEW = 20


def _starts(size: int, probe: int, step: int) -> list[int]:
    starts = [*range(0, max(1, size - probe + 1), max(1, step))]
    return starts + [size - probe] if starts[-1] + probe < size else starts


def probes(rows: list[tuple], q: int, probe: int, rate: float, short: int = 64) -> list[Probes]:
    """Probes of (item_id, text) rows, in groups of much the same bound; short ones apart."""
    values, at, _ = textvec.folded(pa.array([t for _, t in rows], pa.string()), _characters())
    texts, item, is_short = [], [], []
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        own = values[lo + 1 : hi - 1]  # without the spaces at its ends
        if len(own) <= q:
            continue
        for size, step in ((probe, probe // 2), (short, short // 4)):
            if size == probe or size < min(probe, len(own)):
                starts = _starts(len(own), size, step)
                texts += [own[s : s + size] for s in starts]
                item += [i] * len(starts)
                is_short += [size != probe] * len(starts)
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    budget = np.minimum((sizes * rate).astype(np.int64), np.maximum((sizes + 1) // q - 2, 0))
    brief = np.array(is_short)
    low = sizes + 1 - (budget + 1) * q < FEW
    return [_indexed([i for i, _ in rows], np.array(item)[g], [texts[i] for i in np.flatnonzero(g)], budget[g], q) for g in (low & ~brief, ~low & ~brief, brief) if g.any()]


def _indexed(items: list, item: np.ndarray, texts: list, budget: np.ndarray, q: int) -> Probes:
    sizes = np.array([len(t) for t in texts])
    grams = [qgrams(t, q) for t in texts]
    code, own, offset = np.concatenate(grams), np.repeat(np.arange(len(texts)), [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    return Probes(items, item, texts, budget, sizes + 1 - (budget + 1) * q, codes, np.append(first, len(code)), own[order], offset[order], int((sizes + budget).max()))


def _cells(groups: list[Probes]) -> np.ndarray:
    """For each cell a bit for each group that has a q-gram in it."""
    cells = np.zeros(1 << CELL_BITS, np.uint8)
    for g, known in enumerate(groups):
        cells |= (known.starts >= 0).astype(np.uint8) << g
    return cells


def _looked_up(known: Probes, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The index in known.codes of each code, -1 if it is not there: the codes of its cell are tried one by one."""
    found = np.full(len(code), -1, np.int64)
    left, at = np.arange(len(code)), known.starts[cell].astype(np.int64)
    while len(left):
        same = known.codes[at] == code[left]
        found[left[same]] = at[same]
        left, at = left[~same], at[~same] + 1
        more = (at < len(known.codes)) & (known.codes[np.minimum(at, len(known.codes) - 1)] <= code[left])
        left, at = left[more], at[more]
    return found


#: Rows of the pattern between two looks at which candidates are past the budget.
STRIDE = 8


def aligned(pattern: np.ndarray, text: np.ndarray, anchored: int | None = None, most: int = FAR) -> np.ndarray:
    """Edits of each row of `pattern` against each row of `text`, by the place in the band where the pattern ends.

    Row r of the pattern meets the band's places text[r : r + width]; width is what text has more than pattern, plus 1.
    The alignment begins at any place of the band; or at place `anchored`, before which text holds nothing that matches.
    A band's least cost never falls from row to row, so bands above `most` are left as FAR. Patterns have fewer than FAR / 2 values.
    """
    many, size = pattern.shape
    width = text.shape[1] - size + 1
    steps = np.arange(width, dtype=np.int16)[:, None]
    # places first, so that each operation runs along the candidates
    pattern, text = np.ascontiguousarray(pattern.T), np.ascontiguousarray(text.T)
    cost = np.broadcast_to(np.zeros_like(steps) if anchored is None else np.maximum(steps - np.int16(anchored), 0), (width, many)).copy()
    alive, out = np.arange(many), np.full((many, width), FAR, np.int16)
    for r in range(size):
        new = cost + (text[r : r + width] != pattern[r])
        np.minimum(new[:-1], cost[1:] + np.int16(1), out=new[:-1])
        new -= steps
        reach = 1
        while reach < width:  # running minimum over the places
            np.minimum(new[reach:], new[:-reach], out=new[reach:])
            reach *= 2
        new += steps
        cost = new
        if r % STRIDE == STRIDE - 1:
            near = cost.min(axis=0) <= most
            if near.sum() < 0.8 * len(alive):
                alive, cost, pattern, text = alive[near], cost[:, near], pattern[:, near], text[:, near]
                if not len(alive):
                    return out
    out[alive] = cost.T
    return out


def _matches(known: Probes, hit: np.ndarray, cell: np.ndarray, code: np.ndarray, values: np.ndarray, at: np.ndarray, source: np.ndarray):
    """(row, probe, edits, first code point, code point after the last) of all verified bands of a slice.

    code: its q-grams; cell: their cells; hit: whether the cells hold any q-gram of `known`.
    """
    n, span = len(hit), known.span
    # a band needs `bound` hits within probe + budget places: leave out hits that no such stretch holds
    upto = np.zeros(n + span + 1, np.int32)
    np.cumsum(hit, out=upto[1 : n + 1])
    upto[n + 1 :] = upto[n]
    full = upto[span : n + span] - upto[:n] >= max(1, int(known.bound.min()))
    if not full.any():
        return
    edge = np.flatnonzero(np.diff(full.astype(np.int8), prepend=0, append=0))
    inside = np.bincount(edge[::2], minlength=n + 1) - np.bincount(np.minimum(edge[1::2] - 1 + span, n), minlength=n + 1)
    places = np.flatnonzero(hit & (np.cumsum(inside[:-1], dtype=np.int32) > 0))
    found = _looked_up(known, code[places], cell[places])
    places, found = places[found >= 0], found[found >= 0]
    if not len(places):
        return
    times = known.first[found + 1] - known.first[found]
    spot = np.arange(times.sum()) + np.repeat(known.first[found] - (np.cumsum(times) - times), times)
    probe, place = known.probe[spot], np.repeat(places, times)
    row = np.repeat(np.searchsorted(at, places, "right") - 1, times)
    diagonal = place - known.offset[spot] - at[row] + span  # from 0 up
    # bands are two steps of diagonals, each overlaps the next by one: counts of steps are added to those of the step that follows
    step = diagonal // (known.budget[probe] + 1)
    width = int(step.max()) + 2
    keys = np.sort((row * len(known.texts) + probe) * width + step)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    first, count = keys[new], np.diff(np.append(new, len(keys)))
    count[:-1] += np.where(first[1:] == first[:-1] + 1, count[1:], 0)
    few = np.flatnonzero(count >= int(known.bound.min()))
    of, count = first[few], count[few]
    good = count >= known.bound[of // width % len(known.texts)]
    if good.any():
        p, b = of[good] // width % len(known.texts), of[good] % width
        r = of[good] // width // len(known.texts)
        yield from _verified(known, values, at, source, r, p, at[r] - span + b * (known.budget[p] + 1))


def _verified(known: Probes, values, at, source, rows, probe, low):
    """Of bands that begin at diagonal `low`, those that hold an alignment within the budget."""
    sizes = np.array([len(known.texts[p]) for p in probe])
    for size, k in sorted({(int(s), int(known.budget[p])) for s, p in zip(sizes, probe, strict=True)}):
        same = np.flatnonzero((sizes == size) & (known.budget[probe] == k))
        for some in np.array_split(same, -(-len(same) // 2048)):
            pattern = np.stack([known.texts[p] for p in probe[some]]).astype(np.uint32)
            width = 4 * k + 4  # the band's 2 k + 2 diagonals, and k edits to either side
            start = low[some] - k - 1
            index = start[:, None] + np.arange(size + width - 1)
            inside = (index >= at[rows[some], None]) & (index < at[rows[some] + 1, None])
            text = np.where(inside, values[np.clip(index, 0, len(values) - 1)], np.uint64(0)).astype(np.uint32)
            cost = aligned(pattern, text, most=k)
            stop = cost.argmin(axis=1)
            edits = cost[np.arange(len(some)), stop]
            good = np.flatnonzero(edits <= k)
            if not len(good):
                continue
            # backwards from the ends, to find where they begin
            row, end = rows[some[good]], start[good] + size + stop[good]
            back = end[:, None] - 1 + k - np.arange(size + 2 * k)
            ok = (back >= at[row, None]) & (back < end[:, None]) & (back < at[row + 1, None])
            reverse = aligned(pattern[good, ::-1], np.where(ok, values[np.clip(back, 0, len(values) - 1)], np.uint64(0)).astype(np.uint32), k)
            begin = np.maximum(at[row], end - size - reverse.argmin(axis=1) + k)
            last = np.minimum(end, at[row + 1]) - 1
            yield from zip(row.tolist(), probe[some[good]].tolist(), edits[good].tolist(), source[begin].tolist(), (source[last] + 1).tolist(), strict=True)


def _search(groups: list[Probes], q: int):
    """For mapInArrow: a row for each document and item that match."""
    names = ["doc_id", "item_id", "probes", "matched", "edits", "spans"]

    def run(batches):
        total = sum(np.bincount(known.item, minlength=len(known.items)) for known in groups)
        cells = _cells(groups)
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            values, at, source = textvec.folded(batch.column("text"), _characters())
            best: dict[tuple, dict] = {}
            code = qgrams(values, q)
            cell = (code >> np.uint64(64 - CELL_BITS)).astype(np.int32)
            hit = cells[cell]
            for g, known in enumerate(groups):
                for row, probe, edits, start, end in _matches(known, (hit & (1 << g)) != 0, cell, code, values, at, source):
                    of = best.setdefault((row, int(known.item[probe])), {})
                    of.setdefault((g, probe), []).append((edits, start, end))
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for (row, item), of in sorted(best.items()):
                spans: list[list[int]] = []
                for _, start, end in sorted((x for found in of.values() for x in found), key=lambda x: x[1:]):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                out.append((ids[row], groups[0].items[item], int(total[item]), len(of), sum(min(x)[0] for x in of.values()), ",".join(f"{a}:{b}" for a, b in spans)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "spans" else pa.int64()) for name, c in zip(names, columns, strict=True)], names)

    return textvec.lean(run)


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """(item_id, text) rows in blocks of about `most` characters, each collected when it is asked for."""
    sized = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    total = sized.agg(F.sum(F.char_length("text"))).first()[0] or 0
    count = -(-total // most) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * count))
    for i in range(2 * count if count > 1 else 1):
        yield [tuple(r) for r in (sized.filter(part == i) if count > 1 else sized).sort("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 8, probe: int = 128, rate: float = 0.1, block_chars: int = 4_000_000, short: int = 64) -> DataFrame:
    """Rows doc_id, item_id, probes (of the item, of both lengths), matched (of those), edits (over the matched), spans ("start:end,...").

    docs: doc_id, text; benchmark: item_id, text. rate: edits for each character of a probe that still match.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    schema = "doc_id bigint, item_id bigint, probes bigint, matched bigint, edits bigint, spans string"
    out, last = docs.sparkSession.createDataFrame([], schema), None
    for rows in blocks(benchmark, block_chars):
        if last is not None:  # done before the next block is held
            out = out.unionByName(written(last, "matches"))
        known = probes(rows, q, probe, rate, short) if rows else None
        last = docs.mapInArrow(_search(known, q), schema) if known else None
        del rows, known
    return out if last is None else out.unionByName(last)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text has no match. Rows are told apart by 64 bits of doc_id and text, so rows that share a doc_id are judged each.

    The rows that match are few beside the documents, so Spark can choose how to join them.
    """
    taken = {c.lower() for c in docs.columns}
    row = next(c for c in itertools.chain(["_row"], (f"_row{i}" for i in itertools.count())) if c not in taken)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = matches(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(found, row, "left_anti").drop(row)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
