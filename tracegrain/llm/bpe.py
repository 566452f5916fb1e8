"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks; each chunk is split into pre-tokens by itself, in parallel. Two neighbouring
chunks agree on every boundary after the first one that both have in their overlap, so that boundary is where their
pieces are stitched. The pieces are then encoded independently, and decoding concatenates the tokens' raw bytes.

A pre-token at position p depends only on the text from p on, and on at most two characters past its end; so a
boundary of the left chunk is trusted if it ends LOOKAHEAD characters before the chunk does. Texts whose overlap holds
no common boundary (one endless word, say) are encoded in one piece, which is exact as well.

Edge cases: a null or empty text has no tokens and decodes to no bytes; a doc_id that is null or stands on several rows
gives one result row for each row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm import textvec

#: Characters a pre-token may look at past its end.
LOOKAHEAD = 2
#: Pieces whose ids a worker remembers; the memory is emptied when full, which changes no result.
MEMORY = 300_000
#: Pieces of up to so many bytes are merged together, in grids; longer ones singly, with a heap.
WIDTHS = (8, 16, 32)
NEVER = 1 << 40
SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point, as the splitting pattern of public_tokenizers distinguishes them."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
        table[[ord(x) for run in regex.findall(f"{name}+", every) for x in run]] = kind
    return table


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of the texts that lie between offsets; a pre-token ends where the next begins.

    The same split as public_tokenizers.PATTERN: contractions, an optional space before letters, numbers or other
    characters, and white space that leaves its last character to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[0] = True
    new[1:] |= kinds[1:] != kinds[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kind = kinds[start]
    last = edge[end]
    solid = kind != SPACE
    mark = np.zeros(n, bool)
    spaced = np.zeros(len(start), bool)
    spaced[1:] = solid[1:] & ~solid[:-1] & ~edge[start[1:]] & (points[start[1:] - 1] == 0x20)
    mark[start[solid] - spaced[solid]] = True
    mark[start[~solid & last]] = True
    inner = ~solid & ~last
    mark[start[inner & (end - start > 1)]] = True
    tail = end[inner] - 1
    mark[tail[points[tail] != 0x20]] = True
    # contractions: an apostrophe alone that begins a pre-token, then letters
    short = np.flatnonzero((kind == OTHER) & (end - start == 1) & ~spaced & ~last & (points[start] == 0x27))
    short = short[kind[np.minimum(short + 1, len(kind) - 1)] == LETTER]
    if len(short):
        first = end[short]
        stop = end[short + 1]
        a = points[first]
        b = np.where(first + 1 < stop, points[np.minimum(first + 1, n - 1)], 0)
        took = np.isin(a, [ord(x) for x in "stmd"]) * 1
        for x, y in ("re", "ve", "ll"):
            took = np.where((a == ord(x)) & (b == ord(y)), 2, took)
        first, stop, took = first[took > 0], stop[took > 0], took[took > 0]
        mark[first] = False
        rest = first + took
        mark[rest[rest < stop]] = True
    return np.flatnonzero(mark)


class Ranks:
    """A rank file's tokens: ids of pieces, and tables that turn ids into bytes and decimal text."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.tokens = _table(tokens)
        self.decimals = _table([b"%d," % i for i in range(size)])
        self.bytes = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        # every adjacent pair of tokens that merges into a token: key left * size + right, sorted
        pairs = {self.ids[a] * size + self.ids[b]: rank for token, rank in self.ids.items() for i in range(1, len(token)) if (a := token[:i]) in self.ids and (b := token[i:]) in self.ids}
        self.size, self.pairs = size, np.array(sorted(pairs), np.int64)
        self.merges = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.memory: dict[bytes, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merges[at], NEVER)

    def merged_together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of up to `width` bytes: each round merges the best pair of every piece that has one."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.bytes[grid], -1)
        rank = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        todo = np.arange(len(pieces))
        steps = np.arange(width)
        while len(todo):
            own = rank[todo]
            j = own.argmin(axis=1)
            best = own[np.arange(len(todo)), j]
            todo, j, best = todo[best < NEVER], j[best < NEVER], best[best < NEVER]
            if not len(todo):
                break
            shift = np.minimum(steps + (steps > j[:, None]), width - 1)
            new = np.take_along_axis(ids[todo], shift, axis=1)
            new[:, -1] = -1
            new[np.arange(len(todo)), j] = best
            ids[todo] = new
            own = np.take_along_axis(rank[todo], np.minimum(shift[:, :-1], width - 2), axis=1)
            own[:, -1] = NEVER
            k = np.arange(len(todo))
            own[k, np.minimum(j, width - 2)] = self._pair_ranks(new[k, np.minimum(j, width - 2)], new[k, np.minimum(j, width - 2) + 1])
            left = j > 0
            own[k[left], j[left] - 1] = self._pair_ranks(new[k[left], j[left] - 1], new[k[left], j[left]])
            rank[todo] = own
        flat = ids[ids >= 0].astype(np.uint32).tobytes()
        ends = (np.cumsum((ids >= 0).sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank is merged until none has a rank, leftmost first."""
        ids = self.ids
        if piece in ids:
            return [ids[piece]]
        size = len(piece)
        after = list(range(1, size + 1))
        before = list(range(-1, size))
        heap = [(rank, i, 2) for i in range(size - 1) if (rank := ids.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        ends = list(range(1, size + 1))  # end of the part that starts here; 0: no part starts here
        while heap:
            _, i, width = heapq.heappop(heap)
            if not ends[i] or (j := after[i]) >= size or ends[j] - i != width or i + width != ends[j]:
                continue
            ends[i], ends[j] = ends[j], 0
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (rank := ids.get(piece[i : ends[k]])) is not None:
                    heapq.heappush(heap, (rank, i, ends[k] - i))
            if (h := before[i]) >= 0 and (rank := ids.get(piece[h : ends[i]])) is not None:
                heapq.heappush(heap, (rank, h, ends[i] - h))
        out, i = [], 0
        while i < size:
            out.append(ids[piece[i : ends[i]]])
            i = after[i]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        new = set(pieces).difference(memory)
        below = 0
        for width in WIDTHS:
            if own := [x for x in new if below < len(x) <= width]:
                memory.update(zip(own, self.merged_together(own, width), strict=True))
            below = width
        for piece in new:
            if len(piece) > below:
                memory[piece] = np.array(self.merged(piece), np.uint32).tobytes()
        packed = list(map(memory.__getitem__, pieces))
        return np.frombuffer(b"".join(packed), np.uint32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes


def expand(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated strings of the ids, and the offsets of the ids in it."""
    flat, start, size = table
    sizes = size[ids]
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    return flat[np.arange(offsets[-1]) + np.repeat(start[ids] - offsets[:-1], sizes)], offsets


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _encoded(text: pa.Array, path: str):
    """For each text: ids, decimals with a trailing comma, and decoded bytes."""
    data, offsets = textvec.utf8(text)
    points, at, byte = textvec.codepoints(data, offsets)
    starts = boundaries(points, at)
    raw, own = data.tobytes(), ranks(path)
    a = byte[starts]
    b = np.append(a[1:], len(data)) if len(a) else a
    # each distinct pre-token of the slice is looked up once; decoding shows if two of them shared a hash
    _, first, which = np.unique(textvec.word_hashes(data, a, b), return_index=True, return_inverse=True)
    few, sizes = own.encode([raw[x:y] for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True)])
    ids, upto = expand((few, np.cumsum(sizes) - sizes, sizes), which)
    out, out_at = expand(own.tokens, ids)
    out = out.tobytes()
    if out != raw:
        ids, sizes = own.encode([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        out, out_at = expand(own.tokens, ids)
        out = out.tobytes()
    cut = upto[np.searchsorted(starts, at)]
    csv, csv_at = expand(own.decimals, ids)
    csv = csv.tobytes()
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield ids[lo:hi], csv[csv_at[lo] : csv_at[hi]], out[out_at[lo] : out_at[hi]]


def encoder(path: str, keys: list[str], whole: bool):
    """A function for mapInArrow. whole: digests of each text; else ids and bytes of each piece."""

    def run(batches):
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            found = list(_encoded(batch.column("text"), path))
            kept = [batch.column(k) for k in keys]
            counts = pa.array([len(x[0]) for x in found], pa.int64())
            if whole:
                more = [pa.array([hashlib.sha256(x[1][:-1]).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                more = [pa.array([x[1].decode() for x in found], pa.string()), pa.array([x[2] for x in found], pa.binary())]
                names = ["n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*kept, counts, *more], [*keys, *names])

    return textvec.lean(run)


def chunk_rows(docs: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """A row for each overlapping chunk: its number, first character, text and whether it is the last."""
    last = F.ceil(F.col("size") / chunk_chars).cast("int") - 1
    return docs.select("row", "text", F.char_length("text").alias("size")).select("row", F.explode(F.sequence(F.lit(0), last)).alias("k"), last.alias("last"), "text").select(
        "row", "k", "last", F.substring("text", F.col("k") * chunk_chars + 1, F.lit(chunk_chars + overlap)).alias("text")
    )


def _edges(chunk_chars: int, overlap: int):
    """For mapInArrow: boundaries that a chunk has in its overlap with the chunk before, and with the one after."""

    def run(batches):
        for batch in textvec.slices(batches, "text", textvec.SMALL_SLICE):
            data, offsets = textvec.utf8(batch.column("text"))
            points, at, _ = textvec.codepoints(data, offsets)
            starts = boundaries(points, at)
            heads, tails = [], []
            for k, lo, hi in zip(batch.column("k").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo
                heads.append((own[own <= overlap] + k * chunk_chars).tolist())
                own = own[(own >= chunk_chars) & (own + LOOKAHEAD <= hi - lo)]
                tails.append((own + k * chunk_chars).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(heads, kind), pa.array(tails, kind)], ["row", "k", "head", "tail"])

    return textvec.lean(run)


def stitched(long: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """A row for each piece of a long text: row, k, text. Pieces begin where chunks resynchronise."""
    chunks = chunk_rows(long, chunk_chars, overlap)
    edges = chunks.select("row", "k", "text").mapInArrow(_edges(chunk_chars, overlap), "row string, k int, head array<bigint>, tail array<bigint>")
    follow = F.lead("head").over(Window.partitionBy("row").orderBy("k"))
    joint = F.array_min(F.array_intersect("tail", "head_after"))
    cuts = (
        edges.select("row", "k", "tail", follow.alias("head_after"))
        .filter(F.col("head_after").isNotNull())
        .groupBy("row")
        .agg(F.bool_and(joint.isNotNull()).alias("synchronised"), F.sort_array(F.collect_list(joint)).alias("cuts"))
    )
    starts = F.when(F.col("synchronised"), F.concat(F.array(F.lit(0).cast("bigint")), "cuts")).otherwise(F.array(F.lit(0).cast("bigint")))
    pieces = long.join(cuts, "row").select("row", "text", starts.alias("starts")).select("row", "text", "starts", F.posexplode("starts").alias("k", "start"))
    stop = F.coalesce(F.get("starts", F.col("k") + 1), F.char_length("text").cast("bigint"))
    return pieces.select("row", "k", F.substring("text", F.col("start").cast("int") + 1, (stop - F.col("start")).cast("int")).alias("text"))


def encode(docs: DataFrame, path: str | None = None, chunk_chars: int = 32_768, overlap: int = 256) -> DataFrame:
    """Token count and digests of ids and decoded bytes of each row of docs (doc_id, text).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256. Texts of up to chunk_chars characters are one chunk and need
    no shuffle; only longer ones are cut, stitched and put together again by row.
    """
    if overlap > chunk_chars:
        raise ValueError("overlap must not exceed chunk_chars")
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    is_long = F.char_length("text") > chunk_chars
    digests = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short = docs.filter(~is_long).mapInArrow(encoder(path, ["doc_id"], True), digests)
    # equal texts have equal tokens, so a long text is known by its digest and each distinct one is encoded once
    long = docs.filter(is_long).select("doc_id", F.sha2("text", 256).alias("row"), "text")
    pieces = stitched(long.select("row", "text").dropDuplicates(["row"]), chunk_chars, overlap).mapInArrow(encoder(path, ["row", "k"], False), "row string, k int, n_tokens bigint, ids string, decoded binary")
    joined = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    whole = (
        pieces.groupBy("row")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("k", "ids", F.col("decoded").cast("string").alias("decoded")))).alias("parts"))
        .select("row", "n_tokens", F.sha2(F.rtrim(joined("ids"), F.lit(",")), 256).alias("ids_sha256"), F.sha2(joined("decoded"), 256).alias("decoded_sha256"))
    )
    return short.unionByName(long.select("doc_id", "row").join(whole, "row").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
