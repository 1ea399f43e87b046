"""Secret scans that also look into encoded layers: a worklist of decoded layers, scanned until nothing new turns up."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this drops just the short ones
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]+={0,2}")  # in lines, as mail and key files have it
RUN = re.compile(r"\S+")
QUOTED_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")
QUOTED_CHAR = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
WIDE = re.compile(r"(?:[\x01-\x7f]\x00){8,}")  # ASCII in UTF-16, of either byte order
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
ZLIB = re.compile(b"\x78[" + b"".join(re.escape(bytes([x])) for x in range(256) if (0x7800 + x) % 31 == 0) + b"]")
ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*|\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})*|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
CHAIN = re.compile(r"%(?:25)+")
ENDING = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")
#: Decompressed bytes of one document that are searched for further layers. What a document holds beyond them is scanned as a
#: stream, in overlapping pieces, for plain secrets; layers within it are not opened, and ``unopened`` counts such contents.
MAX_UNPACKED = 32 << 20
#: Bytes of such a piece, and of the overlap; longer secrets are found in each piece that holds enough of them.
PIECE, OVERLAP = 1 << 20, 64 << 10
#: Memory that a single xz or Zstandard stream may ask for; streams that want more stay packed and count as ``unopened``.
MAX_WINDOW = 128 << 20
#: Levels of nested escapes that are taken one by one, not counting levels of %25 alone. Deeper ones are resolved at once: plain secrets and base64
#: show there just the same, compressed bytes quoted at such a depth do not, and ``unopened`` counts the document.
MAX_LEVELS = 16

Span = tuple[int, int, str]


def scan(text: str) -> Iterator[Span]:
    """(start, end, kind) of the plain secrets of a text, leftmost and non-overlapping within a kind."""
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= 12:
                    yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield m.start(), m.end(), "access"
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex"


class Layer:
    """A decoded text, and for each of its characters the span of the document that it came from."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray, level: int = 0):
        self.text, self.lo, self.hi, self.level = text, lo, hi, level

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.lo[start:end].min()), int(self.hi[start:end].max())

    def key(self) -> tuple:
        return hashlib.sha1(self.text.encode("utf-8", "surrogatepass")).digest(), int(self.lo[0]), int(self.hi[-1])


def code_point(n: int) -> str:
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def unescaped(found: str) -> tuple[str, list[int]]:
    """What an escape stands for, and for each character how many characters of the escape come before it."""
    if found[0] == "%":
        raw = bytes.fromhex(found.replace("%", ""))
        text = raw.decode("utf-8", "replace")
        if len(text.encode()) != len(raw) or "�" in text:
            text = raw.decode("latin-1")
            return text, [3 * i for i in range(len(text))]
        return text, [3 * int(x) for x in np.cumsum([0] + [len(c.encode()) for c in text[:-1]])]
    if found[0] == "&":
        return code_point(int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])), [0]
    if found[1] == "x" or found[2] == "{":
        return code_point(int(found.strip("\\xu{}"), 16)), [0]
    units = [int(x, 16) for x in found.split("\\u")[1:]]
    text, at, i = [], [], 0
    while i < len(units):
        pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
        text.append(chr(0x10000 + (units[i] - 0xD800 << 10) + units[i + 1] - 0xDC00) if pair else code_point(units[i]))
        at.append(6 * i)
        i += 1 + pair
    return "".join(text), at


def replaced(layer: Layer, found: Iterator[tuple[int, int, str, list[int]]], level: int) -> Layer | None:
    """The layer with (start, end, text, offsets of its characters) put in place, in order; None if there is nothing to put."""
    parts, lo, hi, done = [], [], [], 0
    for start, end, text, at in found:
        parts += [layer.text[done:start], text]
        at = np.array([*at, end - start]) + start
        lo += [layer.lo[done:start], layer.lo[at[:-1]]]
        hi += [layer.hi[done:start], layer.hi[at[1:] - 1]]
        done = end
    if not parts:
        return None
    return Layer("".join([*parts, layer.text[done:]]), np.concatenate([*lo, layer.lo[done:]]), np.concatenate([*hi, layer.hi[done:]]), level)


def without_escapes(layer: Layer) -> Layer | None:
    """The layer with its URL and Unicode escapes replaced; None if it has none.

    Where every escape is a percent sign that was escaped again and again, as many levels as the least nested one has go at once: nothing
    but percent signs would come up between them.
    """
    if not any(x in layer.text for x in ("%", "\\", "&#")):
        return None
    found = [m.span() for m in ESCAPE.finditer(layer.text)]
    chains = [m.span() for m in CHAIN.finditer(layer.text)] if found and all(layer.text.startswith("%25", a) for a, _ in found) else []
    if chains and [a for a, _ in chains] == [a for a, _ in found]:
        # a level takes one 25 of each; the last one is left to a plain step, as what follows it may be an escape then
        levels = min((b - a - 1) // 2 for a, b in chains) - 1
        if levels > 0:
            return replaced(layer, ((a, a + 1 + 2 * levels, "%", [0]) for a, _ in chains), layer.level)
    return replaced(layer, ((a, b, *unescaped(layer.text[a:b])) for a, b in found), layer.level + 1)


def resolved(layer: Layer) -> Layer:
    """The layer with all its escapes replaced, however nested, in one pass: a stack on which an escape is replaced once its last character is there."""
    out: list[str] = []
    lo: list[int] = []
    hi: list[int] = []
    deepest = 12  # characters of the longest escape that is looked for
    for c, a, b in zip(layer.text, layer.lo.tolist(), layer.hi.tolist(), strict=True):
        out.append(c)
        lo.append(a)
        hi.append(b)
        while out[-1] in "0123456789abcdefABCDEF;}":
            tail = "".join(out[-deepest:])
            m = next((m for m in (ENDING.search(tail),) if m), None)
            if m is None:
                break
            text, _ = unescaped(m[0])
            n = len(m[0])
            first, last = min(lo[-n:]), max(hi[-n:])
            del out[-n:], lo[-n:], hi[-n:]
            out += text
            lo += [first] * len(text)
            hi += [last] * len(text)
            if not text:
                break
    return Layer("".join(out), np.array(lo, np.int64), np.array(hi, np.int64), layer.level)


class Budget:
    """What a document may still unpack, the secrets that streams beyond it held, and how many contents were not opened whole."""

    def __init__(self):
        self.left, self.spans, self.unopened = MAX_UNPACKED, set(), 0


def members(raw: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """The members of a compressed string of bytes as (piece, None), and after each (b"", what follows it). Ends where no member begins."""
    while True:
        if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0):
            tool = zlib.decompressobj(31 if raw[:1] == b"\x1f" else 15)
            while raw and not tool.eof:
                yield tool.decompress(raw, PIECE), None
                raw = tool.unconsumed_tail
            raw = tool.unused_data
        elif raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\x00":
            tool = bz2.BZ2Decompressor() if raw[:1] == b"B" else lzma.LZMADecompressor(memlimit=MAX_WINDOW)
            yield tool.decompress(raw, PIECE), None
            while not tool.eof and not tool.needs_input:
                yield tool.decompress(b"", PIECE), None
            raw = tool.unused_data
        elif raw[:4] == b"\x28\xb5\x2f\xfd":
            tool, at = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).decompressobj(), 0
            while at < len(raw) and not tool.eof:  # it takes no bound, so the input goes in by small pieces
                yield tool.decompress(raw[at : at + 1024]), None
                at += 1024
            raw = tool.unused_data + bytes(raw[at:])
        else:
            return
        yield b"", raw


BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError, MemoryError)


def unpacked(raw: bytes, budget: Budget) -> tuple[bytes | None, set[str], int] | None:
    """(content of all members, kinds, bytes that follow them) of a compressed string of bytes; None if it is none or its first member is broken.

    Content that is more than the budget has left is None, with the kinds of the plain secrets that it holds, read as a stream.
    """
    parts, size, whole, rest = [], 0, 0, None
    found = members(raw)
    try:
        for piece, after in found:
            if after is not None:
                whole, rest = len(parts), len(after)
            elif piece:
                parts.append(piece)
                size += len(piece)
            if size > budget.left:
                break
    except BROKEN as error:
        budget.unopened += "emory" in str(error) or "window" in str(error).lower()
    if size <= budget.left:
        if rest is None:
            return None
        content = b"".join(parts[:whole])
        budget.left -= len(content)
        return content, set(), rest
    budget.unopened += 1
    kinds, tail = set(), b"".join(parts)
    try:
        while True:
            kinds |= {k for _, _, k in scan(tail.decode("latin-1"))}
            piece, after = next(found)
            rest = len(after) if after is not None else rest
            tail = tail[-OVERLAP:] + piece
    except StopIteration:
        pass
    except BROKEN:
        pass
    return None, kinds, rest or 0


CONTROL = bytes(x for x in range(128) if not chr(x).isprintable() and x not in b"\t\r\n")


def readable(raw: bytes) -> str | None:
    """raw as text, if it is valid UTF-8 and nine tenths of it are printable."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    fine = len(raw.translate(None, CONTROL)) if raw.isascii() else sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and fine * 10 >= 9 * len(text) else None


def views(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """raw as text, and where in raw each character starts and ends: UTF-8 if it reads as that; else Latin-1, and the same with UTF-16's zeros out.

    Every secret is ASCII, so Latin-1 shows those between bytes that are no text.
    """
    if (text := readable(raw)) is not None:
        first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # no continuation byte: a character begins
        yield text, first, np.append(first[1:], len(raw))
    elif raw:
        text, at = raw.decode("latin-1"), np.arange(len(raw))
        yield text, at, at + 1
        if WIDE.search(text):
            kept = np.ones(len(raw), bool)
            for m in WIDE.finditer(text):
                kept[m.start() + 1 : m.end() : 2] = False
            at = at[kept]
            yield np.frombuffer(raw, np.uint8)[at].tobytes().decode("latin-1"), at, at + 1


def opened(raw: bytes, budget: Budget) -> tuple[bytes | None, set[str]]:
    """raw without further layers of compression; None if one of them is more than the budget has left, with the kinds found in it."""
    seen = {hashlib.sha1(raw).digest()}
    while (inner := unpacked(raw, budget)) is not None:
        raw, kinds, _ = inner
        if raw is None:
            return None, kinds
        if (mark := hashlib.sha1(raw).digest()) in seen:
            break
        seen.add(mark)
    return raw, set()


def packed_parts(raw: bytes, starts: list[int], budget: Budget) -> Iterator[tuple[int, int, bytes | None, set[str]]]:
    """(start, end, content, kinds) of the compressed parts of raw that begin at one of ``starts``, leftmost first, none within another."""
    done, view = 0, memoryview(raw)
    for at in sorted(set(starts)):
        if at >= done and (found := unpacked(view[at:], budget)) is not None:
            content, kinds, rest = found
            done = len(raw) - rest
            yield (at, done, *(opened(content, budget) if content is not None else (None, kinds)))


def spread(layer: Layer, content: bytes | None, kinds: set[str], start: int, end: int, budget: Budget) -> Iterator[Layer]:
    """The views of a content, each character with the span of layer from start to end; of one that is not at hand, its secrets have that span."""
    lo, hi = layer.span(start, end)
    budget.spans |= {(lo, hi, k) for k in kinds}
    for text, _, _ in views(content or b""):
        yield Layer(text, np.broadcast_to(np.int64(lo), len(text)), np.broadcast_to(np.int64(hi), len(text)))


def from_base64(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """Layers for each base64 run, in one line or wrapped, at each of its four alignments, and for compressed parts of what it encodes.

    A run that reads as text from its first character is that text, and other alignments are not tried.
    """
    taken = 0  # runs within a wrapped one that could be read are parts of it
    for m in sorted([*BASE64.finditer(layer.text), *(WRAPPED.finditer(layer.text) if "\n" in layer.text else ())], key=lambda m: (m.start(), -m.end())):
        if m.end() <= taken:
            continue
        found = np.array([i for i, c in enumerate(m[0], m.start()) if c not in "=\r\n"])
        body = "".join(c for c in m[0] if c not in "=\r\n").replace("-", "+").replace("_", "/")
        breaks = [0, *(i + 1 for i, c in enumerate(body) if c in "+/")]
        for skip in range(4):
            part = body[skip : len(body) - ((len(body) - skip) % 4 == 1)]  # one character alone holds no byte
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            starts = [x.start() for x in MAGIC.finditer(raw)] + [o for b in breaks if b >= skip and (b - skip) % 4 == 0 and ZLIB.match(raw, o := (b - skip) // 4 * 3)]
            whole = False
            for start, end, content, kinds in packed_parts(raw, starts, budget):
                whole |= skip == 0 == start and end == len(raw)
                yield from spread(layer, content, kinds, int(found[skip + start * 8 // 6]), int(found[skip + (end * 8 - 1) // 6]) + 1, budget)
            if whole:
                taken = m.end()
                break
            for text, first, last in views(raw):
                yield Layer(text, layer.lo[found[skip + first * 8 // 6]], layer.hi[found[skip + (last * 8 - 1) // 6]])
            if skip == 0 and readable(raw) is not None:
                taken = m.end()
                break


def from_quoted_bytes(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """A layer for each compressed text, URL-quoted, within a run of characters that are not blank."""
    if not QUOTED_BYTE.search(layer.text):
        return
    for m in RUN.finditer(layer.text):
        if "%" not in m[0] or not QUOTED_BYTE.search(m[0]):
            continue
        raw, at = unquote_to_bytes(m[0]), None
        for start, end, content, kinds in packed_parts(raw, [x.start() for x in [*MAGIC.finditer(raw), *ZLIB.finditer(raw)]], budget):
            if at is None:  # where in the run each byte stands
                at = [x.span() for x in QUOTED_CHAR.finditer(m[0]) for _ in range(1 if len(x[0]) == 3 else len(x[0].encode("utf-8", "surrogatepass")))]
            yield from spread(layer, content, kinds, m.start() + at[start][0], m.start() + at[end - 1][1], budget)


def ordered(spans: set[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def search(text: str | None) -> tuple[list[Span], list[Span], int]:
    """(the plain secrets, those and the ones of decoded layers, contents not opened), in order of start and kind; ends are exclusive, in code points.

    The worklist ends because a layer that was seen at the same place is not taken up again. A decoded secret has the span of the
    characters that encode it. Null: nothing.
    """
    if not text:
        return [], [], 0
    base = set(scan(text))
    spans, work, seen, budget = set(base), deque(), set(), Budget()
    if any(x in text for x in ("%", "\\", "&#")) or BASE64.search(text):
        at = np.arange(len(text))
        work.append(Layer(text, at, at + 1))
    while work:
        layer = work.popleft()
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        if len(seen) > 1:
            spans |= {(*layer.span(start, end), kind) for start, end, kind in scan(layer.text)}
        plain = without_escapes(layer)
        if plain is not None and plain.level > MAX_LEVELS:
            plain = resolved(layer)
            budget.unopened += 1
        if plain is not None and plain.text:
            work.append(plain)
        work.extend(from_base64(layer, budget))
        work.extend(from_quoted_bytes(layer, budget))
    return ordered(base), ordered(spans | budget.spans), budget.unopened


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The first two of :func:`search`."""
    return search(text)[:2]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str | None, mark: str) -> str | None:
    """text with every span replaced by the mark; overlapping spans are replaced together."""
    spans = find(text)[1]
    if not spans:
        return text
    out, done, merged = [], 0, []
    for start, end, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``base_spans`` and ``all_spans``, each as kind:start:end, comma-joined, and ``unopened``: how many contents were too large or
    too deeply nested to be opened whole (see MAX_UNPACKED, MAX_WINDOW, MAX_LEVELS). No shuffle; null or empty text: empty strings and 0.

    Columns of these names are replaced. Repeated rows are scanned one by one.
    """

    @F.arrow_udf("base string, all string, unopened long")
    def spans(texts: pa.Array) -> pa.Array:
        found = [(written(b), written(e), n) for b, e, n in (search(t.as_py()) for t in texts)]
        columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["base", "all", "unopened"])

    rest = [c for c in docs.columns if c.lower() not in ("base_spans", "all_spans", "unopened")]
    found = docs.select("*", spans(F.col(text)).alias("__cf_spans"))
    return found.select(*[F.col(f"`{c}`") for c in rest], F.col("__cf_spans.base").alias("base_spans"), F.col("__cf_spans.all").alias("all_spans"), "__cf_spans.unopened")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every secret of the text column, decoded ones included, replaced by the mark; other texts stay as they are."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array((masked(t.as_py(), mark) for t in texts), pa.string())

    return docs.withColumn(text, mask(F.col(text)))
