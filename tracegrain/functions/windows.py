"""Where a text stands in another: exactly, up to white space, or most alike among windows of as many lines."""

from __future__ import annotations

import difflib
import textwrap
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "kind string, start int, end int, line int, ratio double"


def _plain(text: str) -> str:
    """Line ends and trailing space made alike, and common indentation taken off."""
    return textwrap.dedent("\n".join(line.rstrip() for line in text.replace("\r\n", "\n").split("\n")))


#: As the standard library has it: in a text of so many characters, those of which it holds more than a hundredth and one begin no block.
LONG = 200
#: Characters that are looked up together when runs that two texts share are bounded.
RUN = 5


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(codes: np.ndarray) -> np.ndarray:
    """A number for each RUN neighbouring characters; equal ones have equal numbers."""
    found = np.zeros(max(0, len(codes) - RUN + 1), np.uint64)
    for i in range(RUN if len(found) else 0):
        found = found * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(found)]
    return found


def _reach(search: str, content: str, begins: list[str]) -> int:
    """How many characters of the search can stand in matching blocks with any part of the content, if only `begins` begin a block there.

    A block is a run that both texts share, and holds a character that begins one, but for a block at the start of both texts. So a block
    of RUN characters or more lies in a stretch of the search whose runs of RUN all occur in the content, and a character that begins
    a block, or the search's first, stands there; a shorter block lies around such a character.
    """
    own = _codes(search)
    begin = np.isin(own, _codes("".join(begins)))
    begin[:1] = True
    shared = np.isin(_runs(own), _runs(_codes(content)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], shared, [False]))))
    first, last = edges[::2], edges[1::2] + RUN - 1
    upto = np.concatenate(([0], np.cumsum(begin)))
    held = upto[last] > upto[first]
    at = np.flatnonzero(begin)
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, np.concatenate((first[held], np.maximum(at - RUN + 2, 0))), 1)
    np.add.at(cover, np.concatenate((last[held], np.minimum(at + RUN - 1, len(own)))), -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _bounds(lines: list[str], size: int, search: str, least: float) -> np.ndarray:
    """For each window of `size` lines, what its ratio to the search cannot exceed.

    That is twice the characters in common over all and, where that leaves a window `least` or more, twice those that can stand in
    matching blocks with such windows over all.
    """
    wanted = Counter(search)
    order = {c: i for i, c in enumerate(wanted)}
    counts = np.zeros((len(lines) + 1, len(order) + 1), np.int64)
    for i, line in enumerate(lines):
        for c, n in Counter(line).items():
            counts[i + 1, order.get(c, len(order))] += n
    counts = np.cumsum(counts, axis=0)
    own = counts[size:] - counts[:-size]
    if "\n" in order:
        own[:, order["\n"]] += size - 1
    else:
        own[:, -1] += size - 1
    common = np.minimum(own[:, :-1], np.array(list(wanted.values()), np.int64)).sum(axis=1)
    length = own.sum(axis=1)
    total = length + len(search)
    found = np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
    left = found >= least
    if left.any() and length[left].min() >= LONG:
        begins = ((own[left, :-1] > 0) & (own[left, :-1] <= length[left, None] // 100 + 1)).any(axis=0)
        found = np.minimum(found, 2 * _reach(search, "\n".join(lines), [c for c, i in order.items() if begins[i]]) / total)
    return found


#: Characters of a window between two looks at whether it can still be alike enough.
STRIDE = 64


def _alike(masks: dict[str, int], size: int, window: str, least: float) -> bool:
    """Whether the longest common subsequence of a window and a search of `size` characters allows a ratio of `least`.

    Matching blocks are a common subsequence, so the ratio cannot exceed twice its length over all characters. masks: for
    each character of the search the bits of its places. The subsequence's length is the number of zeros in `row`, where
    each of the window's characters clears one bit at most (Hyyro's bit-parallel recurrence).
    """
    total = size + len(window)
    if not total:
        return True
    row = every = (1 << size) - 1
    for at in range(0, len(window), STRIDE):
        for c in window[at : at + STRIDE]:
            if met := row & masks.get(c, 0):
                row = ((row + met) | (row - met)) & every
        common = size - row.bit_count()
        if 2.0 * min(size, common + max(0, len(window) - at - STRIDE)) / total < least:
            return False
    return 2.0 * (size - row.bit_count()) / total >= least


def _masks(search: str) -> dict[str, int]:
    """For each character of the search the bits of its places."""
    masks: dict[str, int] = {}
    for c in set(search):
        bits = _codes(search) == ord(c)
        masks[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return masks


def _ratio(search: str, window: str, least: float) -> float | None:
    """What difflib.SequenceMatcher(None, search, window).ratio() gives, or None once it is sure to be below `least`.

    The same blocks: the longest run of characters that are not too common, the first of equal ones, made longer by
    whatever is equal beside it, then so on to either side. Only places of such characters within the range are looked at,
    and what is matched and could still be is kept count of.
    """
    size, places = len(window), {}
    for j, c in enumerate(window):
        places.setdefault(c, []).append(j)
    if size >= LONG:
        places = {c: at for c, at in places.items() if len(at) <= size // 100 + 1}
    rare = [i for i, c in enumerate(search) if c in places]
    total, matched, todo = len(search) + size, min(len(search), size), [(0, len(search), 0, size)]
    if not total:
        return 1.0
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i0, j0, k0, before, runs = alo, blo, 0, -2, {}
        for i in rare[bisect_left(rare, alo) : bisect_left(rare, ahi)]:
            if i != before + 1:
                runs = {}
            new, own = {}, places[search[i]]
            for j in own[bisect_left(own, blo) : bisect_left(own, bhi)]:
                k = new[j] = runs.get(j - 1, 0) + 1
                if k > k0:
                    i0, j0, k0 = i - k + 1, j - k + 1, k
            before, runs = i, new
        while i0 > alo and j0 > blo and search[i0 - 1] == window[j0 - 1]:
            i0, j0, k0 = i0 - 1, j0 - 1, k0 + 1
        while i0 + k0 < ahi and j0 + k0 < bhi and search[i0 + k0] == window[j0 + k0]:
            k0 += 1
        matched -= min(ahi - alo, bhi - blo)
        if k0:
            sides = [(alo, i0, blo, j0), (i0 + k0, ahi, j0 + k0, bhi)]
            matched += k0 + sum(min(b - a, d - c) for a, b, c, d in sides)
            todo += [x for x in sides if x[0] < x[1] and x[2] < x[3]]
        if 2.0 * matched / total < least:
            return None
    return 2.0 * matched / total


def place(content: str, search: str, threshold: float) -> tuple | None:
    """kind (exact, normalised or fuzzy), start and end in the content, line (from 1) and ratio; None if nothing is alike enough."""
    at = content.find(search)
    if at >= 0:
        return "exact", at, at + len(search), content.count("\n", 0, at) + 1, 1.0
    lines = content.split("\n")
    begins = np.concatenate(([0], np.cumsum([len(line) + 1 for line in lines])))
    span = lambda i, size: (int(begins[i]), int(begins[i + size]) - 1, i + 1)
    wanted = _plain(search).rstrip("\n")
    size = wanted.count("\n") + 1
    first = wanted.split("\n", 1)[0].strip()
    for i in range(len(lines) - size + 1):
        # windows whose first line differs cannot be alike
        if lines[i].strip() == first and _plain("\n".join(lines[i : i + size])).rstrip("\n") == wanted:
            return "normalised", *span(i, size), 1.0
    size = search.count("\n") + 1
    if size > len(lines):
        return None
    best, found = 0.0, None
    bounds = _bounds(lines, size, search, threshold)
    masks = None
    for i in np.argsort(-bounds, kind="stable").tolist():
        # by falling bound: the rest cannot be more alike than the best so far
        if bounds[i] < max(best, threshold):
            break
        masks = _masks(search) if masks is None else masks
        window = "\n".join(lines[i : i + size])
        if not _alike(masks, len(search), window, max(best, threshold)):
            continue
        ratio = _ratio(search, window, max(best, threshold))
        if ratio is None:
            continue
        if ratio > best or ratio == best and found is not None and i < found:
            best, found = ratio, i
    return ("fuzzy", *span(found, size), best) if found is not None and best >= threshold else None


def placed(content: Column, search: Column, threshold: float = 0.85) -> Column:
    """A struct of where the search stands in the content, as `place` finds it; null if it does not, or if one of the two is null."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        for contents, searches in columns:
            rows = [None if a is None or b is None else place(a, b, threshold) for a, b in zip(contents.to_pylist(), searches.to_pylist(), strict=True)]
            fields = [pa.array([r[i] if r else None for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays(fields, names, mask=pa.array([r is None for r in rows], pa.bool_()))

    return F.arrow_udf(run, RESULT)(content, search)


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts, 0 to 1, by their matching blocks: of `b` as the first text and `a` as the one that is indexed."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            yield pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(a, b)
