"""Secret scans that unwrap nested encodings.

Each text is the first entry of a worklist. A layer is scanned for secrets, then unwrapped in every way that applies:
percent escapes, Unicode escapes, base64 tokens, and compressed bytes inside those. What comes out is a new layer
unless the same content came from the same span of the text before (cycle detection); the list runs dry at the fixpoint.
A content is searched and unwrapped once, wherever it stands, and its spans are mapped for every place; of places within
each other (a token with and without its escaped end) the outermost counts. Each layer knows which part of its parent
every character came from, so spans map back, layer by layer, to code points of the text.

A span inside base64 or compressed data maps to the whole encoded token; one across escapes to all of their characters.
A token may begin right behind up to three other letters (or any number, if it holds no compressed bytes); its span then begins at
the first of its characters that were decoded. Tokens may be wrapped in lines of one length of 16 and more. Bytes that are one
whole raw deflate stream are unpacked as such.

Bytes are read as UTF-8, or as latin-1 where they are not that; bytes with a NUL also as UTF-16 of either byte order, from
their first and from their second byte. Bytes that do not look like text make a layer only if something can be found there.

A text's compressed streams may unpack to `expansion` bytes together. One that goes past what is left of them is unpacked
and scanned in windows of 1 MB, each of which begins at least 64 KB, and at most a token, before the last one's end.

Edge cases: a null text counts as empty: no spans, digest of the empty string. Repeated rows and null ids give one
result row each. n_unopened counts what was not scanned whole: such streams within each other more than `DEEP` times, and
windows of 16 MB cut within a token. Escapes nested more than `STEPS` deep are unwrapped to their end in one layer; the
layers between, and compressed bytes escaped so often, are not scanned. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm import textvec

KINDS = ("assign", "access", "hex")
#: The base patterns, and the least lengths of group 2, match and match.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
WORDS = ("passw", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+\r?\n)+[A-Za-z0-9+/]+={0,2}")
SHORT_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,39}\r?\n)+[A-Za-z0-9+/]{1,39}={0,2}(?![A-Za-z0-9+/=])")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|((?:\\x[0-9A-Fa-f]{2})+)")

#: Whether there are any of these; patterns that begin with a fixed sign are found sooner.
ANY_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ANY_ESCAPE = re.compile(r"\\(?:u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
#: Each byte that a run may hold as one letter, all others as a space.
PLAIN = b"a"
CLASSES = bytes(97 if chr(c) in "+/_-" or c < 128 and chr(c).isalnum() else 32 for c in range(256))


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in the text as it is."""
    found = []
    small = text.lower()
    if any(word in small for word in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in RUN.finditer(text) if runs is None else runs:  # a run of hex digits lies within one run of these
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return found


class Layer:
    """A text and where its characters came from: pieces (own start, parent start, parent end, copied as they are)."""

    __slots__ = ("parent", "pieces", "starts", "steps", "text")

    def __init__(self, text: str, parent: Layer | None = None, pieces: list[tuple[int, int, int, bool]] | None = None, steps: int = 0):
        self.text, self.parent, self.pieces, self.steps = text, parent, pieces or [], steps
        self.starts = [p[0] for p in self.pieces]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that the span of this layer came from."""
        layer = self
        while layer.parent is not None:
            own, first, _, same = layer.pieces[bisect.bisect_right(layer.starts, start) - 1]
            last_own, last_first, last_stop, last_same = layer.pieces[bisect.bisect_left(layer.starts, end) - 1]
            start, end, layer = (first + start - own if same else first), (last_first + end - last_own if last_same else last_stop), layer.parent
        return start, end


MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor), (b"x", zlib.decompressobj))
#: Tab and line ends count as printable.
SPACED = dict.fromkeys(b"\t\n\r", " ")
#: In front of a raw deflate stream it makes a zlib stream without its checksum.
ZLIB_HEAD = b"\x78\x9c"
BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)
#: Bytes of a window over a large stream at first and at most, that it shares with the next, and that are unpacked at once.
WINDOW, MOST, SHARED, CHUNK = 1 << 20, 1 << 24, 1 << 16, 1 << 18
DEEP = 8
#: Escapes within escapes are unwrapped one layer at a time so often; then all that are left go in one pass.
STEPS = 8
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: A character, or an escaped sign of escapes as often as it is escaped again.
UNIT = re.compile(r"%(?:25)+|\\(?:u005[cC]|x5[cC])+|.", re.S)
TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\{}\r\n"


class Room:
    """Bytes that a text's streams may still unpack to, what its large streams hold, and layers and gaps within those."""

    def __init__(self, expansion: int, depth: int = 0, streams: dict | None = None):
        self.expansion, self.left, self.depth, self.streams = expansion, expansion, depth, {} if streams is None else streams
        self.layers = self.unopened = 0


def _packed(data: bytes):
    """The decompressor for bytes that begin with a compressed stream, or None."""
    for magic, tool in MAGIC:
        if data.startswith(magic) and (magic != b"x" or len(data) > 2 and int.from_bytes(data[:2]) % 31 == 0):
            try:
                tool().decompress(data[:4096], 1)
            except BROKEN:
                return None
            return tool
    return None


def _unpacked(source: Iterable[bytes]) -> Iterator[bytes]:
    """What the streams in the bytes unpack to, one after another; bytes that are no stream, or a broken one's rest, as they are."""
    tool, data = None, b""
    for more in source:
        data += more
        out = b""
        while data or tool is not None and (not getattr(tool, "needs_input", True) or len(out) == CHUNK):
            if tool is None:
                if (make := _packed(data)) is None:
                    yield data
                    data = b""
                    break
                tool = make()
            try:
                out = tool.decompress(data, CHUNK)
            except BROKEN:
                yield data
                tool, data = None, b""
                break
            if out:
                yield out
            if tool.eof:
                tool, data, out = None, tool.unused_data, b""
            else:
                data = getattr(tool, "unconsumed_tail", b"")


def readings(data: bytes) -> list[str]:
    """The bytes as text, and as UTF-16 if they may be that."""
    try:
        texts = [data.decode("utf-8")]
    except UnicodeDecodeError:
        texts = [data.decode("latin-1")]
    if b"\0" in data:
        texts += [data[at:].decode(code, "replace") for at in (0, 1) for code in ("utf-16-le", "utf-16-be")]
    return texts


def opened(data: bytes, room: Room) -> tuple[list[str], bool]:
    """Readings of decoded bytes, unpacked if they are a stream, and whether they are one or look like text.

    Raises OverflowError if a stream goes past the room.
    """
    packed, seen = False, set()
    while data not in seen and _packed(data):
        seen.add(data)
        parts, size = [], 0
        for part in _unpacked([data]):
            size += len(part)
            if size > room.left:
                raise OverflowError
            parts.append(part)
        packed, data = True, b"".join(parts)
        room.left -= size
    texts = readings(data)
    return texts, packed or texts[0].encode("utf-8", "surrogatepass") == data and texts[0].translate(SPACED).isprintable()


def _windows(source: Iterable[bytes], room: Room) -> Iterator[bytes]:
    """Overlapping windows over a stream that do not cut a token."""
    held, want, new = bytearray(), WINDOW, False
    for more in source:
        held += more
        new = True
        if len(held) < want:
            continue
        tail = len(held) - len(held.rstrip(TOKEN_BYTES))
        if tail > len(held) // 2 and len(held) < MOST:
            want = len(held) * 2
            continue
        yield bytes(held)
        room.unopened += tail > len(held) // 2
        held, want, new = held[-(SHARED if tail > len(held) // 2 else max(SHARED, tail)) :], WINDOW, False
        want = max(want, 2 * len(held))
    if new:
        yield bytes(held)


def streamed(data: bytes, room: Room) -> frozenset[int]:
    """Kinds of the secrets in a stream that is too large to be held whole."""
    mark = hashlib.blake2b(data, digest_size=16).digest()
    if mark in room.streams:
        return room.streams[mark]
    room.layers += 1
    source: Iterable[bytes] = [data]
    for _ in range(DEEP):
        source = _unpacked(source)
        first = b""
        for part in source:
            first += part
            if len(first) >= 64:
                break
        source = itertools.chain([first], source)
        if not _packed(first):
            break
    else:
        room.unopened += 1
    kinds: set[int] = set()
    for window in _windows(source, room):
        of = hashlib.blake2b(window, digest_size=16, person=b"window").digest()
        if of not in room.streams:
            if room.depth >= DEEP:
                room.unopened += 1
            own: set[int] = set()
            for text in readings(window):
                if room.depth < DEEP:
                    _, spans, layers, unopened = scan(text, room.expansion, Room(room.expansion, room.depth + 1, room.streams))
                    room.layers += layers
                    room.unopened += unopened
                    own |= {kind for _, kind, _ in spans}
                else:
                    own |= {kind for _, kind, _ in base_spans(text)}
            room.streams[of] = frozenset(own)
        kinds |= room.streams[of]
    room.streams[mark] = frozenset(kinds)
    return room.streams[mark]


def _may_hold(text: str) -> bool:
    """Whether the text holds a run, an escape or a secret; what is decoded from no token at all is seldom text, and long."""
    return PLAIN * 16 in text.encode("latin-1", "replace").translate(CLASSES) or bool(ANY_ESCAPE.search(text) or ANY_PERCENT.search(text) or base_spans(text, []))


def _rewritten(layer: Layer, pattern: re.Pattern, turn) -> Layer | None:
    """The layer with each match replaced by turn(match); None if nothing changes."""
    out, pieces, at, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = turn(m)
        if new is None or new == m[0]:
            continue
        if m.start() > at:
            out.append(layer.text[at : m.start()])
            pieces.append((size, at, m.start(), True))
            size += m.start() - at
        if new:
            out.append(new)
            pieces.append((size, m.start(), m.end(), False))
            size += len(new)
        at = m.end()
    if not at:
        return None
    if at < len(layer.text):
        out.append(layer.text[at:])
        pieces.append((size, at, len(layer.text), True))
    return Layer("".join(out), layer, pieces, layer.steps + 1) if pieces else None


def _complete(stack: list[tuple[str, int, int, bool]]) -> int:
    """How many of the last characters are one escape; 0 if they are none. Raw bytes are no digits."""
    digits = lambda n: len(stack) >= n and all(c in HEX_DIGITS and not raw for c, _, _, raw in stack[-n:])
    sign = lambda n, c: len(stack) >= n and stack[-n][0] == c
    if stack[-1][0] == "}":
        at = next((n for n in range(2, 9) if sign(n, "{")), 0)
        inner = [c for c, *_ in stack[-at + 1 : -1]] if at else []
        return at + 2 if inner and all(c in HEX_DIGITS for c in inner) and sign(at + 1, "u") and sign(at + 2, "\\") else 0
    if not digits(2):
        return 0
    if sign(3, "%"):
        return 3
    for mark, n in (("x", 2), ("u", 4), ("U", 8)):
        if sign(n + 2, "\\") and sign(n + 1, mark) and digits(n):
            return n + 2
    return 0


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with escapes unwrapped until none is left, in one pass: what is unwrapped can end the next escape."""
    stack: list[tuple[str, int, int, bool]] = []  # character, its source, and whether it is a byte of more than 7 bits
    for m in UNIT.finditer(layer.text):
        char = m[0][0]
        stack.append((char, m.start(), m.end(), False))
        while (char in HEX_DIGITS or char == "}") and (n := _complete(stack)):
            parts = stack[-n:]
            byte = parts[0][0] == "%" or parts[1][0] == "x"
            value = int("".join(c for c, *_ in parts[1 if parts[0][0] == "%" else 2 :]).strip("{}"), 16)
            if value >= 0x110000:
                break
            del stack[-n:]
            char = chr(value)
            stack.append((char, parts[0][1], parts[-1][2], byte and value > 127))
    if len(stack) == len(layer.text):
        return None
    out, pieces, size = [], [], 0
    for raw, group in itertools.groupby(stack, lambda x: (x[3] or 0xD800 <= ord(x[0]) < 0xE000, x[2] - x[1] > 1)):
        own = list(group)
        text = "".join(c for c, *_ in own)
        if raw[0]:
            text = readings(text.encode("latin-1"))[0] if own[0][3] and own[-1][3] else text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
            pieces.append((size, own[0][1], own[-1][2], False))
        elif raw[1]:
            pieces += [(size + i, a, b, False) for i, (_, a, b, _) in enumerate(own)]
        else:
            starts = [i for i in range(len(own)) if not i or own[i][1] != own[i - 1][2]]
            pieces += [(size + i, own[i][1], own[j - 1][2], True) for i, j in zip(starts, [*starts[1:], len(own)], strict=True)]
        out.append(text)
        size += len(text)
    return Layer("".join(out), layer, pieces, layer.steps + 1)


def _escaped(layer: Layer, pattern: re.Pattern, room: Room) -> tuple[list[Layer], list[tuple[int, int, int]]]:
    """The layer without its escapes, layers of other readings of them, and spans of escapes that hold large streams."""
    more, spans = [], []

    def read(m: re.Match, data: bytes) -> str | None:
        try:
            texts, _ = opened(data, room)
        except OverflowError:
            spans.extend((m.start(), kind, m.end()) for kind in streamed(data, room))
            return None
        more.extend(Layer(x, layer, [(0, m.start(), m.end(), False)]) for x in texts[1:] if _may_hold(x))
        return texts[0]

    def turn(m: re.Match) -> str | None:
        if pattern is PERCENT:
            return read(m, bytes.fromhex(m[0].replace("%", "")))
        if m[2]:
            return bytes.fromhex(m[2].replace("\\u", "")).decode("utf-16-be", "replace")
        if m[4]:
            return read(m, bytes.fromhex(m[4].replace("\\x", "")))
        point = int(m[1] or m[3], 16)
        return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None

    new = _rewritten(layer, pattern, turn)
    return ([new] if new else []) + more, spans


def _raw_deflate(data: bytes) -> bool:
    """Whether the bytes are one whole raw deflate stream; what it unpacks to is not kept."""
    tool, size = zlib.decompressobj(-15), 0
    try:
        while data and not tool.eof:
            size += len(tool.decompress(data, CHUNK))
            data = tool.unconsumed_tail
    except zlib.error:
        return False
    return tool.eof and not tool.unused_data and size > 0


def _base64(layer: Layer, token: str, start: int, room: Room) -> tuple[list[Layer], list[tuple[int, int, int]]]:
    """Layers within one token and spans of large streams; if it does not decode to text, also within its parts between / _ and -.

    A token may stand right behind other letters, so it is decoded from each of its first four characters until that gives text.
    """
    bare = re.sub(r"\s", "", token).rstrip("=").translate({45: 43, 95: 47})
    found, spans, end = [], [], start + len(token)
    for phase in range(4 if len(bare) >= 19 else 1):
        if len(bare) % 4 == (1 + phase) % 4:
            continue
        try:
            data = base64.b64decode(bare[phase:] + "=" * (-(len(bare) - phase) % 4))
        except (binascii.Error, ValueError):
            continue
        for packed in (data, ZLIB_HEAD + data) if _raw_deflate(data) else (data,):
            try:
                texts, whole = opened(packed, room)
            except OverflowError:
                return found, spans + [(start + phase, kind, end) for kind in streamed(packed, room)]
            found += [Layer(x, layer, [(0, start + phase, end, False)]) for i, x in enumerate(texts) if x and (whole and not i or _may_hold(x))]
            if whole and texts[0]:
                return found, spans
    for part in re.finditer(r"[A-Za-z0-9+]{16,}={0,2}", token):
        if part[0] != token:
            layers, more = _base64(layer, part[0], start + part.start(), room)
            found += layers
            spans += more
    return found, spans


def _short_lines(text: str) -> Iterator[tuple[str, int]]:
    """Tokens wrapped at fewer than 40 columns: lines of one length, and the next if it is no longer."""
    for block in SHORT_LINES.finditer(text):
        lines = [(m.start(), m.end()) for m in re.finditer(r"[^\s]+", block[0])]
        at = 0
        while at < len(lines) - 1:
            size = lines[at][1] - lines[at][0]
            last = at
            while last < len(lines) - 1 and lines[last][1] - lines[last][0] == size:
                last += 1
            if lines[last][1] - lines[last][0] > size + 2:  # longer, and not by its padding only
                last -= 1
            if last > at:
                yield block[0][lines[at][0] : lines[last][1]], block.start() + lines[at][0]
            at = max(last, at + 1)


def children(layer: Layer, runs: list[re.Match], room: Room) -> tuple[list[Layer], list[tuple[int, int, int]]]:
    """All layers one step below, and (start, kind, end) of what streams hold that were not made layers for their size."""
    found, spans = [], []
    text = layer.text
    if layer.steps >= STEPS and (last := _unescaped(layer)):
        found.append(last)
    for sign, pattern in (("%", PERCENT), ("\\", ESCAPE)) if layer.steps < STEPS else ():
        if sign in text:
            layers, more = _escaped(layer, pattern, room)
            found += layers
            spans += more
    tokens = [(m[0], m.start()) for m in runs]
    if any(len(token) >= 40 for token, _ in tokens):
        tokens += [(m[0], m.start()) for m in LINES.finditer(text)]
    if runs and "\n" in text:
        tokens += _short_lines(text)
    for token, start in tokens:
        layers, more = _base64(layer, token, start, room)
        found += layers
        spans += more
    return found, spans


def _mark(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan(text: str, expansion: int = 1 << 24, room: Room | None = None) -> tuple[list, list, int, int]:
    """Base spans and all spans, as sorted (start, kind, end); distinct layers unwrapped; parts left unopened."""
    runs = list(RUN.finditer(text))
    base = sorted(base_spans(text, runs))
    if not (runs or "%" in text or "\\" in text):
        return base, base, 0, 0
    room = room or Room(expansion)
    below, large = children(Layer(text), runs, room)
    if not below:
        return base, sorted({*base, *large}), room.layers, room.unopened
    places: dict[tuple, set] = {}  # of each secret of a content: where it came from
    seen = set()
    known = {_mark(text): (base + large, below)}  # of each content: its spans, and the layers below
    work = list(below)
    while work:
        layer = work.pop()
        mark, place = _mark(layer.text), layer.source(0, len(layer.text))
        if (mark, place) in seen:
            continue
        seen.add((mark, place))
        if mark not in known:
            runs = list(RUN.finditer(layer.text))
            below, more = children(layer, runs, room) if runs or "%" in layer.text or "\\" in layer.text else ([], [])
            known[mark] = base_spans(layer.text, runs) + more, below
        found, below = known[mark]
        for start, kind, end in found:
            places.setdefault((mark, start, kind, end), set()).add(layer.source(start, end))
        work += [Layer(x.text, layer, x.pieces, x.steps) for x in below]
    spans = {*base, *large}
    for (_, _, kind, _), of in places.items():
        stop = -1
        for a, b in sorted(of, key=lambda x: (x[0], -x[1])):
            if b > stop:
                spans.add((a, kind, b))
                stop = b
    return base, sorted(spans), len(known) - 1 + room.layers, room.unopened


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_unopened bigint"


def _scan_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        rows = {name.split()[0]: [] for name in RESULT.split(", ")}
        for at in range(0, len(column), 64):
            for text in column.slice(at, 64).to_pylist():
                base, spans, layers, unopened = scan(text or "")
                kinds = [kind for _, kind, _ in base]
                values = (*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers, unopened)
                for values_of, value in zip(rows.values(), values, strict=True):
                    values_of.append(value)
        yield pa.StructArray.from_arrays([pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()], list(rows))


def found(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """docs (with a text column) and a struct column of what the scan found in each row."""
    return docs.withColumn(name, F.arrow_udf(_scan_arrays, RESULT)("text"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by [kind]; overlapping spans go as one, under the first one's kind.

    A null text stays null. All other columns stay as they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for at in range(0, len(column), 64):
                for text in column.slice(at, 64).to_pylist():
                    spans = scan(text)[1] if text else []
                    parts, done = [], 0
                    for start, kind, end in spans:
                        if start >= done:
                            parts += [text[done:start], f"[{KINDS[kind]}]"]
                        done = max(done, end)
                    out.append("".join(parts) + text[done:] if spans else text)
            yield pa.array(out, pa.string())

    return docs.withColumn("text", F.arrow_udf(textvec.lean(run), "string")("text"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint"), "text")
    return found(docs).select("doc_id", "secrets.*")
