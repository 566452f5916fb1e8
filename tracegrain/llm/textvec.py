"""Vectorised text primitives for tasks: Arrow columns to byte, code point and word arrays.

Everything here works on one slice of a record batch, so memory is bounded by the
slice limit (or by one text, if a single text is longer than the limit).
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds, unless one text alone is longer.
SLICE_BYTES = 1 << 20
#: The same where a slice's arrays are many times its text: a worker holds a few of them at once.
SMALL_SLICE = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about `limit` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def release() -> None:
    """Give what this process has freed back to the system: Arrow's pool and, where the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for a task's batches, after which the worker keeps no freed memory: workers are used again by other steps."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the rows' offsets in code points, and the byte position of each code point (and the end)."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.searchsorted(at, offsets), np.append(at, len(data))


@functools.cache
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


@functools.cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower()[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than space and \\x09-\\x0D; runs never cross rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~_space()[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: An odd multiplier and its inverse modulo 2**64.
_POWER = 0xD1342543DE82EF95
_INVERSE = pow(_POWER, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        steps = np.full(max(2 * n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _tables[base] = np.cumprod(steps, dtype=np.uint64)
    return _tables[base]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        weighted = _byte_codes()[data] * _powers(_POWER, len(data))[: len(data)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)))
        return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


#: What the digests of hash sequences are kept as: 120 bits.
DIGEST = pa.decimal128(38, 0)


def digests(sequences: list[np.ndarray]) -> pa.Array:
    """A digest of each sequence of hashes as a decimal; null for an empty one."""
    data = b"".join(hashlib.blake2b(x.tobytes(), digest_size=15).digest() + b"\0" for x in sequences)
    valid = np.packbits(np.array([len(x) > 0 for x in sequences], bool), bitorder="little")
    return pa.Array.from_buffers(DIGEST, len(sequences), [pa.py_buffer(valid), pa.py_buffer(data)])


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of n words of one row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for j, salt in enumerate(_salts(n)):
            total += mix(hashes[j : len(hashes) - n + 1 + j] ^ salt) * salt
    return mix(total)[at], at


def folded(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's code points through a table that maps what separates words to a space.

    Runs of spaces become one, and each row begins and ends with one. Returns the values, the offsets of the rows, and
    for each value the code point of its row that it came from.
    """
    data, offsets = utf8(column)
    points, at, _ = codepoints(data, offsets)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(points)) + 2 * rows + 1
    values = np.full(len(points) + 2 * (len(at) - 1), 0x20, table.dtype)
    values[place] = table[points]
    source = np.zeros(len(values), np.int64)
    source[place] = np.arange(len(points)) - at[rows]
    edge = at + 2 * np.arange(len(at))
    source[edge[1:] - 1] = np.diff(at)
    keep = values != 0x20
    keep[1:] |= values[:-1] != 0x20
    keep[edge[:-1]] = True
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    return values[keep], upto[edge], source[keep]
