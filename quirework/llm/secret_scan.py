"""Secret scans with a recursive decoding worklist.

Each text is a layer on a worklist. A layer is scanned, and whatever looks encoded in it
is unwrapped to a new layer: URL and Unicode escapes of the whole layer, and each base64
run (broken into lines or not, glued to other letters or not) whose bytes may be UTF-8,
UTF-16, or compressed (gzip, zlib, bzip2, xz), to any depth. Escapes only shrink a text;
after STEPS layers of them the rest of the chain is undone in one pass, and the text at
its end is scanned. Layers seen before within a run are not entered again, so the work
ends at a fixpoint; every place that holds an encoded secret is reported.

Findings are mapped back to the span of the text that holds them: through escapes
character by character, by one flat list of pieces a layer, through base64 and
compression to the whole run. Decompressed layers are scanned in windows of
``window_bytes`` that overlap, so their size doesn't matter for memory. A stream inside
another is unwrapped from the window that it begins in. What is left unscanned is
reported on its span with the kind ``unscanned``: xz that takes over 80 MB to decode, and
whatever is beyond ``most_bytes`` of decoded layers a text (an archive bomb). Of a damaged
archive what can be decoded is scanned.

Spans are in code points, end exclusive. Null texts count as empty. Texts are scanned
whole, each row by itself, repeated or not; other columns pass through, except one that
is called as the result.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import chunks, small_batches

#: In the order in which kinds with one start are listed.
KINDS = ("assign", "access", "hex", "unscanned")
#: Layers of escapes that are scanned one by one; bytes of a window and of all decoded layers of a text, at most.
STEPS, WINDOW_BYTES, MOST_BYTES = 8, 4 << 20, 1 << 30
#: Bytes by which windows overlap, and that are decompressed at a time.
_OVERLAP, _PIECE = 1 << 16, 1 << 14


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"
_ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more are the longest runs of that length
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_MAP = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
_RUN_MAP = bytes(120 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_LONGEST_ESCAPE = 10
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")  # the shortest assignment, token=abcdef, takes 16
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_SOLID = re.compile(r"\S+")
#: What a decoded run must show to be a layer: text, in one byte a character or two, or the start of a compressed stream.
_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12}|(?:\x00[\t\n\r\x20-\x7e]){12}")
_STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\A\x78")


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; leftmost and non-overlapping within a kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(_LOWER)
    found: list[tuple[int, int, str]] = []
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_MAP):
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


#: A layer's pieces: where each starts, the span of the text that it comes from, and whether that is the same characters.
Pieces = tuple[list[int], list[int], list[int], list[bool]]


def _letter(escape: str) -> str:
    """The character that an escape stands for; bytes beyond ASCII stand for themselves, as no pattern asks for them."""
    digits = escape.strip("%\\&#uUxX{};")
    code = int(digits, 10 if escape[0] == "&" and escape[2] not in "xX" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _pieces(parts: list[tuple[str, int, int, bool]]) -> tuple[str, Pieces]:
    here, low, high, plain, at = [], [], [], [], 0
    for piece, start, end, same in parts:
        here.append(at)
        low.append(start)
        high.append(end)
        plain.append(same)
        at += len(piece)
    return "".join(p[0] for p in parts), (here, low, high, plain)


def unescaped(text: str) -> tuple[str, Pieces] | None:
    """The text with each of its escapes undone once, and its pieces; None if it has none."""
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    parts, at = [], 0
    for m in _ESCAPE.finditer(text):
        if m.start() > at:
            parts.append((text[at : m.start()], at, m.start(), True))
        parts.append((_letter(m.group()), m.start(), m.end(), False))
        at = m.end()
    if not at:
        return None
    if at < len(text):
        parts.append((text[at:], at, len(text), True))
    return _pieces(parts)


def fully_unescaped(text: str) -> tuple[str, Pieces]:
    """The text with its escapes undone until none is left, from the end to the start: each step looks at what is decoded behind it."""
    done: list[tuple[str, int, int, bool]] = []  # from the last character to the first
    for at in range(len(text) - 1, -1, -1):
        item = (text[at], at, at + 1, True)
        while item[0] in "%\\&" and (m := _ESCAPE.match(item[0] + "".join(x[0] for x in reversed(done[1 - _LONGEST_ESCAPE :])))):
            used = len(m.group()) - 1
            item = (_letter(m.group()), at, done[-used][2], False)
            del done[-used:]
        done.append(item)
    return _pieces(done[::-1])


def _place(pieces: Pieces, length: int, start: int, end: int) -> tuple[int, int]:
    """The span that the pieces give to [start, end) of their layer."""
    here, low, high, plain = pieces
    first, last = bisect_right(here, start) - 1, bisect_right(here, end - 1) - 1
    return low[first] + (start - here[first] if plain[first] else 0), low[last] + end - here[last] if plain[last] else high[last]


def _through(inner: Pieces, size: int, outer: Pieces, outer_size: int) -> Pieces:
    """The pieces of an inner layer in terms of what the outer pieces refer to."""
    here, low, high, plain = [], [], [], []
    for at, start, end, same in zip(*inner):
        # a plain stretch may span several of the outer pieces
        cuts = [start]
        if same:
            k = bisect_right(outer[0], start)
            while k < len(outer[0]) and outer[0][k] < end:
                cuts.append(outer[0][k])
                k += 1
        for a, b in zip(cuts, [*cuts[1:], end]):
            x, y = _place(outer, outer_size, a, b)
            here.append(at + (a - start if same else 0))
            low.append(x)
            high.append(y)
            plain.append(same and y - x == b - a and outer[3][bisect_right(outer[0], a) - 1])
    return here, low, high, plain


class TooMuch(Exception):
    """A layer can't be decoded within the limits."""


def _engine(magic: bytes):
    if magic[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if magic[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if magic[:1] == b"\xfd":
        return lzma.LZMADecompressor(memlimit=80 << 20)  # the highest preset takes 65 MB
    return zlib.decompressobj()


def _parts(engine, data: bytes, at: int) -> Iterator[bytes]:
    """What ``engine`` makes of ``data`` from ``at`` on, in pieces; returns where its stream ends, or None if it doesn't."""
    keeps_input = hasattr(engine, "needs_input")
    left = b""
    while not engine.eof:
        if not left and (not keeps_input or engine.needs_input):
            left = data[at : at + _PIECE]
            at += len(left)
        given = len(left)
        part = engine.decompress(left, _PIECE << 4)
        left = b"" if keeps_input else engine.unconsumed_tail
        if part:
            yield part
        elif not given:
            return None  # the end is missing
    return at - len(left) - len(engine.unused_data)


def decompressed(data: bytes, start: int, window: int) -> Iterator[bytes]:
    """The stream that begins at ``start``, all its members and what follows them, in overlapping windows; nothing if it is none."""
    held, fresh, at = bytearray(), 0, start
    overlap = min(_OVERLAP, window // 4)
    while at is not None and (m := _STREAM.match(data, at)):
        parts, at = _parts(_engine(m.group()), data, at), None
        try:
            while True:
                part = next(parts)
                held += part
                fresh += len(part)
                while len(held) >= window:
                    yield bytes(held[:window])
                    held = held[window - overlap :]
                    fresh = max(0, len(held) - overlap)
        except StopIteration as end:
            at = end.value
        except lzma.LZMAError as error:
            if "limit" in str(error).lower():
                raise TooMuch from error
        except (zlib.error, OSError, EOFError, ValueError):
            pass  # damaged: what came before counts
    if fresh:
        yield bytes(held) + (data[at : at + window] if at is not None else b"")


def decoded_runs(layer: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the base64 runs of a layer whose bytes may be a layer, at each alignment."""
    if b"x" * 16 not in layer.encode("utf-8", "surrogatepass").translate(_RUN_MAP):
        return
    spans = [m.span() for m in _BASE64.finditer(layer)]
    for start, end in [*spans, *wrapped_runs(layer)]:
        run = "".join(layer[start:end].split()).rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):  # letters glued to the front shift what follows
            body = run[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                continue
            if _TEXT.search(data) or _WIDE.search(data) or _STREAM.search(data):
                yield start, end, data


class Inside:
    """The kinds of secrets inside the bytes of a run, by depth; what was asked before is remembered."""

    def __init__(self, window: int, most: int):
        self.window, self.left, self.known = window, most, {}

    def kinds(self, data: bytes) -> dict[str, int]:
        key = xxhash.xxh3_128_digest(data)
        if key not in self.known:
            self.known[key] = self._search(data)
        return self.known[key]

    def _search(self, data: bytes) -> dict[str, int]:
        found: dict[str, int] = {}
        seen: set[bytes] = set()
        work: deque[tuple[bytes | str, int, int]] = deque([(data, 1, 0)])  # a layer, its depth, and how many escapes led to it
        try:
            while work:
                layer, depth, steps = work.popleft()
                key = xxhash.xxh3_128_digest(layer) if isinstance(layer, bytes) else xxhash.xxh3_128_digest(b"t" + layer.encode("utf-8", "surrogatepass"))
                if key in seen:
                    continue
                seen.add(key)
                self.left -= len(layer)
                if self.left < 0:
                    raise TooMuch
                if isinstance(layer, str):
                    for _, _, kind in find_secrets(layer):
                        found[kind] = min(depth, found.get(kind, depth))
                    if steps <= STEPS and (undone := unescaped(layer)):
                        work.append(((undone if steps < STEPS else fully_unescaped(layer))[0], depth + 1, steps + 1))
                    work += ((inner, depth + 1, 0) for _, _, inner in decoded_runs(layer))
                    continue
                if _WIDE.search(layer):
                    work += ((layer.decode(code, "replace"), depth, 0) for code in ("utf-16-le", "utf-16-be"))
                work.append((layer.decode("utf-8", "replace"), depth, 0))
                for m in _STREAM.finditer(layer):
                    for part in decompressed(layer, m.start(), self.window):
                        if len(part) < self.window:
                            work.append((part, depth, 0))
                            continue
                        self.left -= len(part)
                        if self.left < 0:
                            raise TooMuch
                        for kind, deeper in self.kinds(part).items():  # one of several windows: at once, so that one is held at a time
                            found[kind] = min(found.get(kind, depth + deeper), depth - 1 + deeper)
        except TooMuch:
            found["unscanned"] = 1
        return found


def scan_layers(text: str, window_bytes: int = WINDOW_BYTES, most_bytes: int = MOST_BYTES) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, depth) of the findings of all layers, in spans of ``text``; each span and kind once."""
    found: dict[tuple[int, int, str], int] = {}
    inside = Inside(window_bytes, most_bytes)
    layer, depth, pieces = text, 0, None

    def put(start: int, end: int, kind: str, at: int) -> None:
        place = (start, end) if pieces is None else _place(pieces, len(layer), start, end)
        found[*place, kind] = min(at, found.get((*place, kind), at))

    while True:
        for start, end, kind in find_secrets(layer):
            put(start, end, kind, depth)
        for start, end, data in decoded_runs(layer):
            for kind, deeper in inside.kinds(data).items():
                put(start, end, kind, depth + deeper)
        undone = unescaped(layer) if depth <= STEPS else None
        if not undone:
            break
        inner, fresh = undone if depth < STEPS else fully_unescaped(layer)
        pieces = fresh if pieces is None else _through(fresh, len(inner), pieces, len(layer))
        layer, depth = inner, depth + 1
    return sorted(((a, b, k, d) for (a, b, k), d in found.items()), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def wrapped_runs(layer: str) -> Iterator[tuple[int, int]]:
    """Spans of base64 that is broken into lines of one length; the first may follow other text, the last be shorter or not belong to it."""
    for m in _WRAPPED.finditer(layer):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _SOLID.finditer(m.group())]
        size, k = [b - a for a, b in lines], 0
        while k < len(lines):
            end = k + 1
            while end < len(lines) and size[end] == size[k]:
                end += 1
            stop = end + (end < len(lines) and size[end] < size[k])
            for first in {k, max(k - 1, 0)}:
                for last in {end, stop}:
                    if last - first > 1:
                        yield lines[first][0], lines[last - 1][1]
            k = end


def scan_secrets(docs: DataFrame, text_col: str = "text", window_bytes: int = WINDOW_BYTES, most_bytes: int = MOST_BYTES, result_col: str = "secrets") -> DataFrame:
    """``docs`` with an array of findings: start, end, kind and the depth of the layer (0: the text itself)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("depth", pa.int32())]))

    @F.arrow_udf("array<struct<start: bigint, end: bigint, kind: string, depth: int>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for part in chunks(batch):
                rows += [[dict(zip(("start", "end", "kind", "depth"), x)) for x in scan_layers(t or "", window_bytes, most_bytes)] for t in part.to_pylist()]
            yield pa.array(rows, kind)

    return small_batches(docs).withColumn(result_col, scan(F.col(text_col).cast("string")))


def _spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_columns(found: Column) -> dict[str, Column]:
    """Counts and digest of the base findings, and all spans as text."""
    base = F.filter(found, lambda x: x["depth"] == 0)
    kinds = F.transform(base, lambda x: x["kind"])
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS[:3]}
    return counts | {"base_sha256": F.sha2(_spans(base), 256), "spans": _spans(found)}


def masked(text: str, mask: str, window_bytes: int = WINDOW_BYTES, most_bytes: int = MOST_BYTES) -> str:
    """The text with each finding, or run of findings that overlap or touch, replaced by ``mask``."""
    parts, at = [], 0
    for start, end, _, _ in scan_layers(text, window_bytes, most_bytes):
        if start > at or not parts:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", window_bytes: int = WINDOW_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping or touching spans by one."""

    @F.arrow_udf("string")
    def cover(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str | None] = []
            for part in chunks(batch):
                out += [t and masked(t, mask, window_bytes, most_bytes) for t in part.to_pylist()]
            yield pa.array(out, pa.string())

    return small_batches(docs).withColumn(text_col, cover(F.col(text_col).cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns])
