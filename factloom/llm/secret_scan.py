"""Operator 3: secret scan with a recursive decoding worklist.

A document is the first layer. Each layer is scanned for secrets and searched for encoded parts: percent escapes and
Unicode escapes (decoded in place), base64 runs and compressed data (decoded by themselves). What they decode to joins the
worklist until nothing new comes; a layer equal to one it descends from is a cycle and ends there, and one that other steps
have led to already, with the same places, is not read again. Every layer carries, for
each of its characters, the first and last place it came from in the document, so a secret found anywhere is reported as a
span of the document. Compressed data is opened as a stream, through as many layers as it has, and scanned in overlapping
windows. The worklist goes depth first and holds one part of each open layer, so memory stays bounded.

Defined results: null and empty texts have no spans (the digest of the empty string); repeated rows each get a row; a null
doc_id stays null; other columns are ignored; a span found in several layers is reported once.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, utf8

KINDS = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
WINDOW, OVERLAP = 4 << 20, 64 << 10
#: Encoded runs up to this size are kept in one window; longer ones are decoded as streams.
HELD = 8 << 20
MARK = "[SECRET]"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_DEEP_PERCENT = re.compile(r"%25(?:25)+")
_UNICODE = re.compile(r"[\\%]u[dD][89abAB][0-9A-Fa-f]{2}[\\%]u[dD][c-fC-F][0-9A-Fa-f]{2}|[\\%]u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,12}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]+;|&#[xX][0-9A-Fa-f]+;")
#: Bytes written in a text: in URLs, where + is a space and unreserved characters stand for themselves, and as escapes of a string.
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])+")
_URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.")
_QUOTED = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|[\\%]u00[0-9A-Fa-f]{2}|\\u\{0*[0-9A-Fa-f]{1,2}\}|\\U000000[0-9A-Fa-f]{2}|&#0*[0-9]{1,3};|&#[xX]0*[0-9A-Fa-f]{1,2};|[\x20-\x7e])+""")
_QUOTED_BYTE = re.compile(r"""\\x[0-9A-Fa-f]{2}|[\\%]u00[0-9A-Fa-f]{2}|\\u\{0*[0-9A-Fa-f]{1,2}\}|\\U000000[0-9A-Fa-f]{2}|&#0*[0-9]{1,3};|&#[xX]0*[0-9A-Fa-f]{1,2};|\\[abfnrtv0\\'"]|.""")
_SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
_LINE_BREAK = r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*"
#: Base64 in one line or wrapped at any width; LEAST characters in all, as no secret encodes to fewer.
LEAST = 20
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:{_LINE_BREAK}[A-Za-z0-9+/_-]++)++|[A-Za-z0-9+/_-]{{{LEAST},}})={{0,2}}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: No secret and nothing that encodes one is shorter than 16 characters, all of them printable ASCII.
_STRETCH = re.compile(rb"[\t-\r\x20-\x7e]{16,}")
_WIDE = re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){15,}[\t-\r\x20-\x7e]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
_TO_STANDARD = bytes.maketrans(b"-_", b"+/")

Span = tuple[int, int, int]  # start, kind, end: sorts as asked


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind. A failing assignment still takes its characters."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """text, and for each character the place in the document where it starts and ends (None: the document itself)."""

    __slots__ = ("ancestors", "ends", "own", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None, ancestors: frozenset[bytes]):
        self.text, self.starts, self.ends, self.ancestors, self.own = text, starts, ends, ancestors, None

    def lineage(self) -> frozenset[bytes]:
        """Digests of this layer and of those around it."""
        if self.own is None:
            self.own = self.ancestors | {_digest(self.text)}
        return self.own

    def mark(self) -> bytes:
        """Digest of text and places."""
        h = hashlib.blake2b(self.text.encode("utf-8", "replace"), digest_size=16)
        for places in (self.starts, self.ends):
            one = places.strides == (0,)  # one place for all characters
            h.update(places[:1].tobytes() if one else np.ascontiguousarray(places, np.int64).tobytes())
        return h.digest()

    def place(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start:end].min()), int(self.ends[start:end].max()))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def _tool(head: bytes) -> object | None:
    """A decompressor for gzip, zlib, bzip2 or xz data that starts so; None for other data."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and int.from_bytes(head[:2], "big") % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _decompressed(pieces: Iterator[bytes], tool, left: list[int] | None = None) -> Iterator[bytes]:
    """What compressed data gives, piece by piece; members that follow one another are read on, damaged ends are dropped.
    left: gets the number of bytes of the last piece that are not the data's."""
    try:
        for rest in pieces:
            while True:
                piece = tool.decompress(rest, WINDOW)
                rest = getattr(tool, "unconsumed_tail", b"")
                if piece:
                    yield piece
                if tool.eof:
                    rest = tool.unused_data
                    if left is not None:
                        left[:] = [len(rest)]
                    again = _tool(rest)
                    if again is None:
                        return
                    tool = again
                elif not rest and (not piece or getattr(tool, "needs_input", False)):
                    break
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def _inflate(data: bytes, left: list[int] | None = None, more: Iterator[bytes] = iter(())) -> Iterator[bytes] | None:
    """Pieces of what is inside the compressed layers around it, however many; None for data that is not compressed. Layers
    that start with the same piece as one around them are a cycle and end there."""
    if _tool(data) is None:
        return None
    pieces, first, seen, depth = more, data, set(), 0
    while first and (tool := _tool(first)) is not None:
        depth += 1
        inner = _decompressed(chain([first], pieces), tool, left if depth == 1 else None)
        opened = next(inner, b"")
        if not opened:
            return chain([first], pieces) if depth > 1 else iter(())  # it looked compressed and is not
        mark = hashlib.blake2b(first, digest_size=16).digest()
        if mark in seen:
            return iter(())
        seen.add(mark)
        first, pieces = opened, inner
    return chain([first], pieces)


_BASE64_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
_ENCODED = _BASE64_BYTES + b"%\\&#;.~!*'(){}=\r\n"
_NOT_ENCODED = re.compile(b"[^" + re.escape(_ENCODED) + b"]")
_NOT_BASE64 = re.compile(b"[^" + re.escape(_BASE64_BYTES) + b"]")


def _streamed(opened: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    """Overlapping windows of a stream that can be opened again, none cutting an encoded run of up to HELD bytes, and the windows
    of what longer runs give."""
    tail, base, seen, long = b"", 0, 0, False
    for piece in opened():
        window = tail + piece
        run = window[len(window.rstrip(_ENCODED)) :].lstrip(b"\r\n")
        start = len(window) - len(run)
        long = long and start == 0
        if run and not long and len(run) <= HELD:
            end = start
        else:
            end = len(window)
        if base + end > seen:
            yield window[:end]
            seen = base + end
        if len(run) > HELD and not long:
            yield from _long_run(opened, base + start)
            long = True
        at = max(0, end - OVERLAP)
        tail, base = window[at:], base + at
    if base + len(tail) > seen:
        yield tail


def _long_run(opened: Callable[[], Iterator[bytes]], offset: int) -> Iterator[bytes]:
    """Windows of what the encoded run at this offset of a stream gives."""

    def run() -> Iterator[bytes]:
        skip = offset
        for piece in opened():
            rest = piece[skip:]
            skip = max(0, skip - len(piece))
            stop = _NOT_ENCODED.search(rest)
            yield rest[: stop.start()] if stop else rest
            if stop:
                return

    def base64s(shift: int) -> Iterator[bytes]:
        have, skip = b"", shift
        for piece in run():
            piece = piece.replace(b"\\r", b"").replace(b"\\n", b"").translate(_TO_STANDARD, b"\r\n")
            stop = _NOT_BASE64.search(piece)
            have += piece[: stop.start()] if stop else piece
            skipped = min(skip, len(have))
            have, skip = have[skipped:], skip - skipped
            whole = len(have) // 4 * 4
            if whole:
                yield base64.b64decode(have[:whole])
            have = have[whole:]
            if stop:
                break
        yield _decoded(have)

    def percents() -> Iterator[bytes]:
        have = b""
        for piece in run():
            have += piece
            cut = have.rfind(b"%", max(0, len(have) - 2))
            cut = len(have) if cut < 0 else cut
            yield unquote_to_bytes(have[:cut])
            have = have[cut:]
        yield unquote_to_bytes(have)

    def inside(decoded: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
        first = next((x for x in decoded() if x), b"")
        for m in _MAGIC.finditer(first):
            def inflated(at: int = m.start()) -> Iterator[bytes]:
                pieces = (x for x in decoded() if x)
                return _inflate(memoryview(next(pieces))[at:], None, pieces) or iter(())

            if next(inflated(), b""):
                yield from _streamed(inflated)
                break
        yield from (w for w in _streamed(decoded) if _STRETCH.search(w))

    for shift in range(4):
        yield from inside(lambda shift=shift: base64s(shift))
    if any(b"%" in piece for piece in run()):
        yield from inside(percents)


def _decoded(run: bytes) -> bytes:
    """The bytes of a base64 run without padding."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + b"=" * (-len(run) % 4))


def _texts(data: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
    """(text, first byte, bytes of each character) of what can be read in any data: all of it, each byte that is no UTF-8 as a
    character of its own, and stretches of two bytes a character."""
    if _STRETCH.search(data):
        try:
            text = data.decode("utf-8")
            size = np.ones(len(text), np.int64) if len(text) == len(data) else np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
        except UnicodeDecodeError:
            text, size = data.decode("latin-1"), np.ones(len(data), np.int64)
        yield text, 0, size
    for m in _WIDE.finditer(data) if b"\x00" in data else ():
        text = m[0][::2].decode()
        yield text, m.start(), np.full(len(text), 2)


def _byte(x: str) -> int:
    """The byte that an escape or a plain character stands for."""
    if len(x) == 1:
        return ord(x)
    if x[0] == "&":
        return (int(x[3:-1], 16) if x[2] in "xX" else int(x[2:-1])) & 255
    if x[0] == "%":
        return int(x[1:].lstrip("u"), 16)
    if x[2:3] == "{":
        return int(x[3:-1], 16)
    return int(x[2:], 16) if x[1] in "xuU" else _SHORT.get(x[1], ord(x[1]))


def _in_place(layer: Layer, found: list[tuple[int, int, str, list[int] | None]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The layer's text with [start, end) replaced by texts. widths: characters that each new character stands for (None: all)."""
    n = len(layer.text)
    own_starts = np.arange(n) if layer.starts is None else layer.starts
    own_ends = np.arange(1, n + 1) if layer.ends is None else layer.ends
    parts, starts, ends, last = [], [], [], 0
    for s, e, new, widths in found:
        parts += [layer.text[last:s], new]
        starts.append(own_starts[last:s])
        ends.append(own_ends[last:s])
        if new:
            edge = s + np.concatenate([[0], np.cumsum(widths)]) if widths else np.array([s] * len(new) + [e])
            first, final = edge[:-1], (edge[1:] if widths else np.full(len(new), e))
            starts.append(own_starts[first])
            ends.append(own_ends[final - 1])
        last = e
    parts.append(layer.text[last:])
    starts.append(own_starts[last:])
    ends.append(own_ends[last:])
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def _unescape(m: re.Match) -> str:
    x = m[0]
    if x[0] == "&":
        digits = (x[3:-1] if x[2] in "xX" else x[2:-1]).lstrip("0")
        code = int(digits or "0", 16 if x[2] in "xX" else 10) if len(digits) < 8 else 0
    elif x[2] == "{":
        code = int(x[3:-1], 16)
    elif len(x) == 12:
        code = 0x10000 + ((int(x[2:6], 16) - 0xD800) << 10) + int(x[8:12], 16) - 0xDC00
    else:
        code = int(x[2:], 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unicode_marks(text: str) -> list[tuple[int, int, str, None]]:
    """(start, end, character) of the escapes. One that gives the first character of another is followed at once, so a chain of
    escapes takes one layer, not one each."""
    found, m = [], _UNICODE.search(text)
    while m:
        start, end, new = m.start(), m.end(), _unescape(m)
        while new in "\\&%" and (further := _UNICODE.match(new + text[end : end + 64])):
            end, new = end + further.end() - 1, _unescape(further)
        found.append((start, end, new, None))
        m = _UNICODE.search(text, end)
    return found


def unwrap(layer: Layer) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The layers directly inside this one."""
    text = layer.text

    def whole(s: int, e: int, new: str) -> tuple[str, np.ndarray, np.ndarray]:
        a, b = layer.place(s, e)
        return new, np.broadcast_to(a, len(new)), np.broadcast_to(b, len(new))  # one place for all characters

    def inflated(data: bytes, s: int, e: int, left: list[int] | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for window in _streamed(lambda: _inflate(data, left) or iter(())):
            yield whole(s, e, window.decode("utf-8", "replace"))

    def based(runs: list[tuple[int, int]], end: int, shifts: Iterable[int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """What base64 in these places of the text, read as one run, gives from its first characters on: a text may start at any
        character, compressed data at any byte."""
        joined = "".join(text[a:b] for a, b in runs).encode().translate(_TO_STANDARD)
        at = np.concatenate([np.arange(a, b) for a, b in runs])
        for shift in shifts:
            data, after = _decoded(joined[shift:]), 0
            for m in _MAGIC.finditer(data):
                if m.start() >= after:
                    left: list[int] = []
                    yield from inflated(memoryview(data)[m.start() :], int(at[shift + m.start() // 3 * 4]), end, left)
                    after = len(data) - left[0] if left else 0
            for new, start, size in _texts(data):
                to = start + np.cumsum(size)
                first, final = at[shift + (to - size) // 3 * 4], at[np.minimum(shift - (-to // 3) * 4, len(joined)) - 1]
                yield new, first if layer.starts is None else layer.starts[first], final + 1 if layer.ends is None else layer.ends[final]

    def spelt(token: re.Pattern, each: re.Pattern, mark: re.Pattern, plus: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """What compressed data gives whose bytes are written as escapes and plain characters."""
        for t in token.finditer(text):
            if not mark.search(t[0]):
                continue
            items = [(x[0], t.start() + x.start()) for x in each.finditer(t[0])]
            data, after = bytes(_byte(plus if x == "+" else x) for x, _ in items), 0
            places = [p for _, p in items] + [t.end()]
            for m in _MAGIC.finditer(data):
                if m.start() < after:
                    continue
                left: list[int] = []
                rest = memoryview(data)[m.start() :]
                for _ in _decompressed(iter([rest]), _tool(rest), left):
                    pass  # to see where it ends
                end = len(data) - left[0] if left else len(data)
                yield from inflated(rest[: end - m.start()], places[m.start()], places[end])
                after = end if left else 0

    if "%2525" in text:  # escapes of escapes of percent signs: to the last but one at once
        yield _in_place(layer, [(m.start(), m.end(), "%25", None) for m in _DEEP_PERCENT.finditer(text)])
    elif "%" in text and (runs := list(_PERCENT.finditer(text))):
        yield from spelt(_URL, _URL_BYTE, _PERCENT, " ")
        found = []
        for m in runs:
            data = bytes.fromhex(m[0].replace("%", ""))
            new = data.decode("utf-8", "replace")
            widths = [3 * len(c.encode()) for c in new]
            found.append((m.start(), m.end(), new, widths if sum(widths) == len(m[0]) else None))
        yield _in_place(layer, found)
    if ("\\" in text or "&#" in text or "%u" in text) and (marks := _unicode_marks(text)):
        yield from spelt(_QUOTED, _QUOTED_BYTE, _UNICODE, "+")
        yield _in_place(layer, marks)
    for m in _BASE64.finditer(text):
        runs = [x.span() for x in _LINE.finditer(re.sub(r"\\[rn]", "  ", m[0]))]
        runs = [(m.start() + a, m.start() + b) for a, b in runs]
        if sum(b - a for a, b in runs) < LEAST:
            continue
        if len(runs) > 1:  # each line by itself, then all as one
            for run in runs:
                if run[1] - run[0] >= LEAST:
                    yield from based([run], run[1], (0,))
        yield from based(runs, m.end(), range(4))


def layers(text: str) -> Iterator[Layer]:
    """The text and all layers inside it, depth first; of each open layer one part at a time is held. Layers of equal text and
    places, however they were reached, are read once; one equal to a layer around it is a cycle."""
    top = Layer(text, None, None, frozenset())
    yield top
    seen: set[bytes] = set()
    work = [(top, unwrap(top))]
    while work:
        layer, parts = work[-1]
        part = next(parts, None)
        if part is None:
            work.pop()
            continue
        new, starts, ends = part
        if not new or _digest(new) in layer.lineage():
            continue
        child = Layer(new, starts, ends, layer.lineage())
        mark = child.mark()
        if mark in seen:
            continue
        seen.add(mark)
        yield child
        work.append((child, unwrap(child)))


def scan(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and the number of layers read."""
    base, every, read = base_spans(text), set(), 0
    for layer in layers(text):
        read += 1
        for s, kind, e in base if read == 1 else base_spans(layer.text):
            a, b = layer.place(s, e)
            every.add((a, kind, b))
    return base, sorted(every), read


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in utf8(batch.column(1)):
            base, every, read = scan(t.decode())
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every), read))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], SCHEMA_NAMES)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def redacted(text: str) -> str:
    """text with every span, overlapping ones as one, replaced by a mark."""
    parts, last = [], 0
    for s, _, e in scan(text)[1]:
        if s >= last:
            parts += [text[last:s], MARK]
        last = max(last, e)
    return "".join([*parts, text[last:]])


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text and n_chars counted anew; all other columns stay."""
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
        cols = list(batch.columns)
        cols[at] = pa.array(new, batch.column(at).type)
        return pa.RecordBatch.from_arrays(cols, names)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
