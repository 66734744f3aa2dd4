"""Secret scans through nested encodings."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import aside, extended, others, small_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});", re.A)
#: A run of base64, over line breaks too.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}", re.A)
_BODY = re.compile(r"[A-Za-z0-9+/_-]+", re.A)
#: Written bytes: percent escapes or backslash and character escapes, with the printable bytes that stand for themselves.
_PERCENT_BYTES = (re.compile(r"[!-~]+"), re.compile(r"%([0-9A-Fa-f]{2})|[!-~]"), re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]"))
_ESCAPE_BYTES = (
    re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[0abtnvfr\\'\"]|[\x20-\x5b\x5d-\x7e])+"),
    re.compile(r"(?:\\x|\\u00)([0-9A-Fa-f]{2})|&#x0*([0-9A-Fa-f]{1,2});|&#([0-9]{1,3});|\\([0abtnvfr\\'\"])|[ -~]"),
    re.compile(r"\\x[0189A-Fa-f]|\\u00[0189A-Fa-f]|&#"),
)
_SIMPLE = dict(zip("0abtnvfr\\'\"", b"\0\a\b\t\n\v\f\r\\'\"", strict=True))
#: Printable parts long enough for a match, in ASCII and in UTF-16 of either order.
_ASCII = re.compile(rb"[\t\n\r -~]{14,}")
_WIDE = re.compile(rb"(?:[\t\n\r -~]\0){14,}|(?:\0[\t\n\r -~]){14,}")
#: Where a gzip, bzip2, xz or zlib stream may start.
_HEAD = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|[\x08\x18\x28\x38\x48\x58\x68\x78](?s:.)")
#: Bytes of one compressed layer that are held at once. A stream beyond it is searched in pieces and counted in `oversized`.
MOST_BYTES = 32 << 20
#: Bytes given to a decompressor at once, and taken from it.
STEP, PIECE = 1 << 16, 1 << 20
#: Least bytes of a large stream that are searched at once; bytes that the next ones start with: more than the shortest match of each kind.
WINDOW, OVERLAP = 4 << 20, 64
#: What ends a base64 run, a run of written bytes (and what starts their escapes), and UTF-16 text.
_OPEN = (
    (re.compile(rb"[^A-Za-z0-9+/_\r\n\t -]|[^\r\n\t ][\t ]|\n[\t ]*\r?\n"), None),
    (re.compile(rb"[^!-~]"), re.compile(rb"%[0-9A-Fa-f]?(?:[0-9A-Fa-f]|$)")),
    (re.compile(rb"[^ -~]"), re.compile(rb"\\|&#")),
    (re.compile(rb"(?=[^\0][^\0]|\0\0).|[^\0\t\n\r -~]", re.S), None),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every match in a text, code points, by start and then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return _sorted(out)


def _sorted(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class _Layer:
    """A text and, for each of its characters, the span of the document that it came from (None: itself)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Of characters [i, j) in the document."""
        return (i, j) if self.starts is None else (int(self.starts[i:j].min()), int(self.ends[i:j].max()))

    def marks(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(i, j), np.arange(i + 1, j + 1)) if self.starts is None else (self.starts[i:j], self.ends[i:j])


_PLAIN = b"\t\n\r" + bytes(range(32, 127))


def _text_of(raw: bytes) -> str | None:
    """Text, if the bytes are UTF-8 and nearly all of it can be printed."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    if text.isprintable():
        return text or None
    odd = len(raw.translate(None, _PLAIN)) if text.isascii() else sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return text if text and odd * 20 <= len(text) else None


def _byte_marks(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From marks of UTF-8 bytes to marks of characters."""
    if _is_same(starts) and _is_same(ends):
        n = len(raw.decode())
        return _same(starts[0], n), _same(ends[0], n)
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((b & 0xC0) != 0x80)
    return np.minimum.reduceat(starts, at), np.maximum.reduceat(ends, at)


def _same(mark: int, n: int) -> np.ndarray:
    """n equal marks in the memory of one."""
    return np.broadcast_to(np.int64(mark), n)


def _is_same(marks: np.ndarray) -> bool:
    return len(marks) > 1 and not marks.strides[0]


def _maker(raw: bytes, at: int):
    """A decompressor for the stream that starts at a place; None if none does."""
    if raw[at : at + 3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[at : at + 6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if raw[at : at + 2] == b"\x1f\x8b" or len(raw) > at + 2 and raw[at] & 0x0F == 8 and (raw[at] << 8 | raw[at + 1]) % 31 == 0:
        return zlib.decompressobj(47)
    return None


def _unfold(raw: bytes, at: int, end: list[int], broken: list | None = None) -> Iterator[bytes]:
    """What the stream at a place and the members right behind it hold, in pieces; end[0] becomes the place behind them.

    A broken stream gives what it holds up to the break, and its start goes to ``broken``.
    """
    while (maker := _maker(raw, at)) is not None:
        start, deflate = at, not hasattr(maker, "needs_input")
        try:
            while not maker.eof:
                data = maker.unconsumed_tail if deflate else b""
                if not data and (deflate or maker.needs_input):
                    data = raw[at : at + STEP]
                    at += len(data)
                    if not data:
                        if deflate and (piece := maker.flush()):
                            yield piece
                        break
                if piece := maker.decompress(data, PIECE):
                    yield piece
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            if broken is not None:
                broken.append(start)
            return
        if not maker.eof:
            return
        at -= len(maker.unused_data)
        end[0] = at


def inflate(raw: bytes) -> Iterator[tuple[int, int, bytes | Iterator[bytes]]]:
    """(start, end, content) of the zlib, gzip, bzip2 and xz streams in bytes; content over MOST_BYTES comes in pieces.

    A broken or cut stream ends with the bytes, and the search goes on within it.
    """
    at = 0
    while m := _HEAD.search(raw, at):
        if _maker(raw, m.start()) is None:
            at = m.start() + 1
            continue
        end, parts, size = [m.start() + 1], [], 0
        pieces = _unfold(raw, m.start(), end)
        for piece in pieces:
            size += len(piece)
            parts.append(piece)
            if size > MOST_BYTES:
                yield m.start(), len(raw), chain(_drained(parts), pieces)
                break
        else:
            if size:
                yield m.start(), end[0] if end[0] > m.start() + 1 else len(raw), b"".join(parts)
        at = end[0]


def _drained(parts: list[bytes]) -> Iterator[bytes]:
    parts.reverse()
    while parts:
        yield parts.pop()


def _open_from(raw: bytes) -> int:
    """Where the first run starts that may go on behind the bytes: an encoded one, UTF-16 text or a stream."""
    first = len(raw)
    for ends, sign in _OPEN:
        size, at = 1 << 12, None
        while at is None:
            low = max(0, len(raw) - size)
            for m in ends.finditer(raw, low):
                at = m.end()
            if at is None and not low:
                at = 0
            size *= 4
        if sign:
            at = max(at, (m.start() if (m := sign.search(raw, at)) else len(raw)) - 16)
        first = min(first, at)
    at = 0
    while (m := _HEAD.search(raw, at)) and m.start() < first:
        end = [-1]
        at = m.start() + 1
        if _maker(raw, m.start()) is not None and _is_cut(raw, m.start(), end):
            first = m.start()
        at = max(at, end[0])
    return max(0, first - 1) if raw[-1:] in b"\x08\x18\x28\x38\x48\x58\x68\x78\x1f\xfdB" else first


def _is_cut(raw: bytes, at: int, end: list[int]) -> bool:
    """Whether the stream at a place goes on behind the bytes."""
    for _ in _unfold(raw, at, end, broken := []):
        pass
    return not broken and end[0] < 0 or end[0] == len(raw)


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """A stream in windows, so that every match and every encoded run of it is whole in one, but for blanks within a match.

    A window ends where no run is open; a longer run is held whole. Only whether there is a
    match counts, as all of a stream's matches map to one span, so the last bytes of a window,
    each run of blanks as one, start the next.
    """
    held, least = bytearray(), WINDOW
    for piece in chain(pieces, [None]):
        held += piece or b""
        if piece is not None and len(held) < least:
            continue
        raw = bytes(held)
        stop = len(raw) if piece is None else _open_from(raw)
        if stop > OVERLAP or piece is None:
            yield raw[:stop]
            held = bytearray(re.sub(rb" {2,}", b" ", raw[:stop])[-OVERLAP:] + raw[stop:])
        least = max(WINDOW, 2 * len(held))


def _replaced(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every match decoded; None if there is none. decode: text, byte marks and code of a match, or None."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m, layer)
        if got is None:
            continue
        for text, (s, e) in ((layer.text[at : m.start()], layer.marks(at, m.start())), got):
            parts.append(text)
            starts.append(s)
            ends.append(e)
        at = m.end()
    if not at:
        return None
    if layer.starts is not None and _is_same(layer.starts) and _is_same(layer.ends):
        text = "".join([*parts, layer.text[at:]])
        return _Layer(text, _same(layer.starts[0], len(text)), _same(layer.ends[0], len(text)))
    s, e = layer.marks(at, len(layer.text))
    return _Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, s]), np.concatenate([*ends, e]))


def _percent(m: re.Match, layer: _Layer):
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        raw, text = raw.decode("latin-1").encode(), raw.decode("latin-1")
        if len(raw) * 3 != m.end() - m.start():
            s, e = layer.span(m.start(), m.end())
            return text, (np.full(len(text), s), np.full(len(text), e))
    s, e = layer.marks(m.start(), m.end())
    each = np.arange(0, len(s), 3)
    return text, _byte_marks(raw, np.minimum.reduceat(s, each), np.maximum.reduceat(e, each))


def _escape(m: re.Match, layer: _Layer):
    code = int(next(x for x in m.groups()[:5] if x), 16) if not m[6] else int(m[6])
    if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
        return None
    s, e = layer.span(m.start(), m.end())
    return chr(code), (np.array([s]), np.array([e]))


def _holds(raw: bytes, text: bool = True) -> bool:
    """Whether bytes may hold a match or a stream."""
    return bool(text and _ASCII.search(raw) or b"\0" in raw and _WIDE.search(raw)) or any(_maker(raw, m.start()) for m in _HEAD.finditer(raw))


def _of_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray, whole: tuple[int, int], counts: dict, text: bool = True, seen: frozenset = frozenset()) -> Iterator[_Layer]:
    """The texts in bytes, given the marks of each: all of it or its printable parts, and what its streams hold."""
    if (key := hashlib.sha256(raw).digest()) in seen:
        return
    if text and (got := _text_of(raw)) is not None:
        yield _Layer(got, *_byte_marks(raw, starts, ends))
        return
    for m in _ASCII.finditer(raw) if text else ():
        yield _Layer(m[0].decode(), starts[m.start() : m.end()], ends[m.start() : m.end()])
    for m in _WIDE.finditer(raw) if b"\0" in raw else ():
        i, j = m.span()
        yield _Layer(m[0].replace(b"\0", b"").decode(), np.minimum(starts[i:j:2], starts[i + 1 : j : 2]), np.maximum(ends[i:j:2], ends[i + 1 : j : 2]))
    for i, j, below in inflate(raw):
        s, e = int(starts[i:j].min()) if i else whole[0], int(ends[i:j].max()) if j < len(raw) else whole[1]
        if not isinstance(below, bytes):
            counts["oversized"] += 1
        for part in [below] if isinstance(below, bytes) else _windows(below):
            yield from _of_bytes(part, _same(s, len(part)), _same(e, len(part)), (s, e), counts, True, seen | {key})


def _written(layer: _Layer, kind: tuple, counts: dict) -> Iterator[_Layer]:
    """The streams and UTF-16 texts in bytes that are written as escapes between printable ones."""
    run, one, sign = kind
    if not sign.search(layer.text):
        return
    for m in run.finditer(layer.text):
        if not sign.search(m[0]):
            continue
        each, at = [], []
        for x in one.finditer(layer.text, m.start(), m.end()):
            code = next((g for g in x.groups()[:2] if g), None)
            if code:
                each.append(int(code, 16))
            elif x.lastindex == 3:
                each.append(int(x[3]) & 255)
            else:
                each.append(_SIMPLE[x[4]] if x.lastindex == 4 else ord(x[0]))
            at.append(x.start())
        raw = bytes(each)
        for raw in dict.fromkeys((raw, raw.replace(b"+", b" "))) if kind is _PERCENT_BYTES else (raw,):
            if _holds(raw, False):
                s, e = layer.marks(m.start(), m.end())
                i = np.array(at) - m.start()
                yield from _of_bytes(raw, np.minimum.reduceat(s, i), np.maximum.reduceat(e, i), layer.span(m.start(), m.end()), counts, False)


def _unwrapped(layer: _Layer, counts: dict) -> Iterator[_Layer]:
    """The layers directly below one."""
    text = layer.text
    if "%" in text and (got := _replaced(layer, _PERCENT, _percent)):
        yield got
        yield from _written(layer, _PERCENT_BYTES, counts)
    if ("\\" in text or "&#" in text) and (got := _replaced(layer, _UNICODE, _escape)):
        yield got
        yield from _written(layer, _ESCAPE_BYTES, counts)
    for m in _BASE64.finditer(text):
        lines = [(x.start(), x.end()) for x in _BODY.finditer(text, m.start(), m.end())]
        for run in [lines, *([x] for x in lines if len(lines) > 1 and x[1] - x[0] >= 16)]:
            body = "".join(text[i:j] for i, j in run).replace("-", "+").replace("_", "/")
            stop = m.end() if run[-1] == lines[-1] else run[-1][1]
            for shift in range(4):
                part = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
                raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
                if not _holds(raw):
                    continue
                s, e = layer.marks(run[0][0], stop)
                if _is_same(s) and _is_same(e):
                    yield from _of_bytes(raw, _same(s[0], len(raw)), _same(e[0], len(raw)), (int(s[0]), int(e[0])), counts)
                    continue
                at = np.concatenate([np.arange(i, j) for i, j in run]) - run[0][0]
                i = shift + np.arange(len(raw)) // 3 * 4 + np.arange(len(raw)) % 3
                starts, ends = s[at[i]], e[at[np.minimum(i + 1, len(at) - 1)]]
                yield from _of_bytes(raw, starts, ends, layer.span(run[0][0] + int(at[shift]), stop), counts)


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """(base spans, spans that decoding adds, streams too large to hold).

    A stack of layers: each is searched, its matches mapped to the document, and
    every encoding in it unwrapped onto the stack, until nothing new comes. A layer
    equal in text and place to an earlier one is not taken again, so cycles end.
    """
    base = base_spans(text)
    have, added, seen = set(base), set(), set()
    counts = {"oversized": 0}
    work = [_unwrapped(_Layer(text), counts)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        for i, j, kind in base_spans(layer.text):
            span = (*layer.span(i, j), kind)
            if span not in have:
                added.add(span)
        work.append(_unwrapped(layer, counts))
    return base, _sorted(added), counts["oversized"]


def masked(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that meet or overlap become one mark."""
    out, at, end = [], 0, -1
    for i, j, _ in sorted(spans):
        if i > end:
            out += [text[at:i], mark]
            at = end = j
        elif j > end:
            at = end = j
    return "".join([*out, text[at:]]) if spans else text


SPAN = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` (its ``keep`` columns) with base_spans, added_spans, oversized, and the masked text if ``redact``.

    Spans are code points of the whole text, end exclusive. Null text counts as empty
    and stays null when masked. Rows are taken one by one, so ties, repeats and null
    ids need no rule. Columns of the new names, in any case, are replaced. No shuffle.
    """
    new = ("base_spans", "added_spans", "oversized")
    keep, col = others(docs.columns if keep is None else keep, new), aside(docs, "text")
    rows = small_batches(docs.select(*keep, F.col(text_col).cast("string").alias(col)))
    schema = extended(docs, keep, f"base_spans {SPAN}, added_spans {SPAN}, oversized int")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, added, large, texts = [], [], [], []
            for text in b.column(col):
                text = text.as_py()
                x, y, n = scan_text(text or "")
                base.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in x])
                added.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in y])
                large.append(n)
                if redact:
                    texts.append(text if text is None else masked(text, x + y))
            columns = {c: b.column(c) for c in keep}
            if redact:
                columns[text_col] = pa.array(texts, b.column(col).type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(base, span_type), pa.array(added, span_type), pa.array(large, pa.int32())], [*columns, *new])

    return rows.mapInArrow(run, schema)
