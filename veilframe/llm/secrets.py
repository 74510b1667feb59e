"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned by the patterns below; then its
percent escapes, its character escapes (backslash and numeric references), its base64 runs and
compressed data inside these are unwrapped into new layers, until no layer is new. A layer that
has the same content over the same place of the original as one before (a cycle, or two ways to
the same text) is left out. Matches in a layer are mapped back, layer by layer, to the characters
of the original that they were decoded from. A projection of rows: no shuffle; memory is a
text's layers, of which decompressed ones are read in segments.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

from veilframe.llm.common import map_texts

# The patterns, their order, and the length that a match (or its group) must have.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
URL_SAFE = str.maketrans("-_", "+/")
UTF8 = re.compile(rb"(?:[\t\n\r\f\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})++")
HEADER = re.compile(rb"(?P<deflate>\x1f\x8b\x08[\x00-\x1f]|x[\x01^\x9c\xda])|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\(\xb5/\xfd")
#: No secret is shorter: the shortest name, a sign and ASSIGN_LENGTH characters.
LEAST = 14
MAGIC = ((b"\x1f\x8b", "gzip"), (b"x\x01", "zlib"), (b"x^", "zlib"), (b"x\x9c", "zlib"), (b"x\xda", "zlib"),
         (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"(\xb5/\xfd", "zstd"))
#: Decompressed data is scanned in segments of about so many bytes, cut where no pattern can cross.
SEGMENT = 8 << 20
NO_TOKEN = re.compile(rb"[^A-Za-z0-9+/_.=%\\&#;:\"' -]")


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of one layer; leftmost, not overlapping within a kind."""
    found = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if b"token" in lower or b"secret" in lower or b"passw" in lower or b"apikey" in lower or b"api_key" in lower:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if b"akia" in lower:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


class Layer:
    """Text, and where each part of it stands in the layer around it.

    `pieces` are (start here, start outside, characters here, characters outside); characters of a
    piece either stand one for one, or together for all of the outside piece.
    """

    def __init__(self, text: str, outer: Layer | None = None, pieces: list[tuple[int, int, int, int]] | None = None, depth: int = 0) -> None:
        self.text, self.outer, self.pieces, self.depth = text, outer, pieces or [], depth
        self.begins = [p[0] for p in self.pieces]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that a span of this layer comes from."""
        layer = self
        while layer.outer is not None:
            a, b = (layer.pieces[bisect_right(layer.begins, x) - 1] for x in (start, max(start, end - 1)))
            start = a[1] + (start - a[0] if a[2] == a[3] else 0)
            end = b[1] + (end - b[0] if b[2] == b[3] else b[3])
            layer = layer.outer
        return start, end


def _replaced(layer: Layer, runs: list[tuple[int, int, list[tuple[str, int]]]]) -> Layer | None:
    """The layer with runs (start, end, decoded characters and the length each had) put in place."""
    if not runs:
        return None
    parts, pieces, at, here = [], [], 0, 0

    def piece(text: str, outside: int, length: int) -> None:
        nonlocal here
        if text:
            pieces.append((here, outside, len(text), length))
            parts.append(text)
            here += len(text)

    for start, end, decoded in runs:
        piece(layer.text[at:start], at, start - at)
        at = start
        for text, length in decoded:
            piece(text, at, length)
            at += length
        at = end
    piece(layer.text[at:], at, len(layer.text) - at)
    return Layer("".join(parts), layer, pieces, layer.depth + 1)


def percent_decoded(layer: Layer) -> Layer | None:
    runs = []
    if "%" in layer.text:
        for m in PERCENT.finditer(layer.text):
            # bytes that are no UTF-8 stay escaped
            at, decoded = m.start(), []
            for c in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
                length = 3 * len(c.encode("utf-8", "surrogateescape"))
                decoded.append((layer.text[at:at + 3] if "\udc80" <= c <= "\udcff" else c, length))
                at += length
            runs.append((m.start(), m.end(), decoded))
    return _replaced(layer, runs)


def _escaped(code: str) -> str | None:
    if code.count("\\u") == 2 and "{" not in code:
        high, low = int(code[2:6], 16), int(code[8:12], 16)
        return chr(0x10000 + ((high - 0xD800) << 10) + low - 0xDC00)
    if code.startswith("&#"):
        value = int(code[3:-1], 16) if code[2] in "xX" else int(code[2:-1])
    else:
        value = int(code[2:].strip("{}"), 16)
    return chr(value) if value <= 0x10FFFF and not 0xD800 <= value < 0xE000 else None


def unescaped(layer: Layer) -> Layer | None:
    runs = []
    if "\\" in layer.text or "&#" in layer.text:
        for m in ESCAPE.finditer(layer.text):
            text = _escaped(m.group())
            if text is not None:
                runs.append((m.start(), m.end(), [(text, m.end() - m.start())]))
    return _replaced(layer, runs)


class _Inflated(io.RawIOBase):
    """A zlib stream to read from, in bounded steps."""

    def __init__(self, data: bytes) -> None:
        self.engine, self.rest = zlib.decompressobj(), data

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        out = self.engine.decompress(self.rest, n)
        self.rest = self.engine.unconsumed_tail
        return out


def _reader(data: bytes, kind: str):
    if kind == "zlib":
        return _Inflated(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))
    return {"gzip": gzip.open, "bz2": bz2.open, "xz": lzma.open}[kind](io.BytesIO(data))


def compression(data: bytes) -> str | None:
    return next((kind for magic, kind in MAGIC if data.startswith(magic)), None)


def decompressed(data: bytes, kind: str) -> Iterator[bytes]:
    """Segments of the decompressed data; what precedes a defect counts."""
    held = b""
    try:
        reader = _reader(data, kind)
        # one read at a time: what a gzip member held before a defect or foreign bytes behind it is not lost
        read = reader.read1 if kind == "gzip" else reader.read
        while more := read(1 << 20):
            held += more
            if len(held) >= SEGMENT:
                cut = max((m.end() for m in NO_TOKEN.finditer(held, len(held) - (SEGMENT >> 3))), default=0)
                if cut:
                    yield held[:cut]
                    held = held[cut:]
                elif len(held) >= 4 * SEGMENT:  # no end of a token in sight: let the next segment begin a little before
                    yield held
                    held = held[-4096:]
    except Exception as error:  # each library has errors of its own for data that only looks compressed
        if not isinstance(error, (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError)) and "zstd" not in type(error).__module__ and "Zstd" not in type(error).__name__:
            raise
    if held:
        yield held


def printable(data: bytes) -> Iterator[tuple[int, str]]:
    """(first byte, text) of the stretches of printable UTF-8 that are long enough for a secret."""
    for m in UTF8.finditer(data):
        if m.end() - m.start() < LEAST:
            continue
        at = m.start()
        for good, chars in groupby(m.group().decode("utf-8", "surrogateescape"), lambda c: c.isprintable() or c in "\t\n\r\f"):
            text = "".join(chars)
            size = len(text.encode("utf-8", "surrogateescape"))
            if good and size >= LEAST:
                yield at, text
            at += size


def _compressed_at(data: bytes) -> Iterator[int]:
    """Where compressed data may begin: at the front, and wherever a group of four characters does."""
    if compression(data):
        yield 0
    for m in HEADER.finditer(data, 1):
        if m.start() % 3 == 0:
            if m.lastgroup == "deflate":
                try:
                    zlib.decompressobj(47).decompress(data[m.start():m.start() + 4096], 64)
                except zlib.error:
                    continue
            yield m.start()


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """Layers of base64 runs: the stretches that are text, or begin as compressed data, at each of the four alignments.

    Groups of four characters decode each for itself, so words, paths and lines glued before or behind only
    spoil their own part.
    """
    for m in BASE64.finditer(layer.text):
        run = m.group().rstrip("=")
        begins, offsets, size = [], [], 0
        for line in LINE.finditer(run):
            begins.append(size)
            offsets.append(m.start() + line.start() - size)
            size += line.end() - line.start()
        joined = re.sub(r"[\r\n]", "", run).translate(URL_SAFE)

        def outside(i: int) -> int:
            return m.end() if i >= size else i + offsets[bisect_right(begins, i) - 1]

        for skip in range(4):
            body = joined[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            for at in _compressed_at(data):
                start = outside(skip + at // 3 * 4)
                for inner in _unpacked(data[at:], set()):
                    yield Layer(inner.decode("utf-8", "replace"), layer, [(0, start, -1, m.end() - start)], layer.depth + 1)
            for at, text in printable(data):
                pieces = []
                for here, c in enumerate(text):
                    to = at + len(c.encode())
                    # the groups of four that hold the bytes of the character
                    first, last = outside(skip + at // 3 * 4), skip + -(-to // 3) * 4
                    pieces.append((here, first, 1, (outside(last - 1) + 1 if last <= size else m.end()) - first))
                    at = to
                yield Layer(text, layer, pieces, layer.depth + 1)


def _unpacked(data: bytes, seen: set[bytes]) -> Iterator[bytes]:
    """What compressed data holds, through all compressed layers; data met before ends it."""
    kind, mark = compression(data), xxhash.xxh3_128_digest(data)
    if kind is None:
        yield data
    elif mark not in seen:
        seen.add(mark)
        for segment in decompressed(data, kind):
            yield from _unpacked(segment, seen)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    for unwrap in (percent_decoded, unescaped):
        if (inner := unwrap(layer)) is not None:
            yield inner
    yield from base64_layers(layer)


def find(text: str | None) -> list[dict]:
    """All spans of a text, ordered by start, kind and end; `base` marks those of the text itself."""
    found: dict[tuple[int, int, int], tuple[bool, int]] = {}
    # a stack of iterators, so that the segments of a large layer are made one after the other
    work, seen = [iter([Layer(text or "")])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = (xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass")), *layer.origin(0, len(layer.text)))
        if mark in seen:
            continue
        seen.add(mark)
        for start, end, kind in matches(layer.text):
            first, last = layer.origin(start, end)
            found.setdefault((first, kind, last), (layer.outer is None, layer.depth))
        work.append(unwrapped(layer))
    return [{"kind": KINDS[k], "start": a, "end": b, "base": base, "depth": depth} for (a, k, b), (base, depth) in sorted(found.items())]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("base", T.BooleanType()), T.StructField("depth", T.IntegerType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("depth", pa.int32())])


def scan(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys and `secrets`: the spans of each text (code points, end exclusive).

    A span has its kind, whether it stands in the text itself (`base`), and the number of layers
    it was unwrapped from. Null and empty texts have no spans; repeated rows have equal spans;
    other columns are ignored; an empty table gives no rows.
    """

    def make():
        return lambda texts: [pa.array([find(t) for t in texts], pa.list_(_ARROW_SPAN))]

    return map_texts(df, keys, text, [T.StructField("secrets", T.ArrayType(SPAN))], make)


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by a mark."""
    if not text:
        return text
    out, at = [], 0
    for span in find(text):
        if span["end"] > at:
            if span["start"] >= at:
                out += [text[at:span["start"]], mark]
            at = span["end"]
    return "".join([*out, text[at:]])


def mask(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "masked") -> DataFrame:
    """The keys and the text without its secrets; null stays null."""

    def make():
        return lambda texts: [pa.array([masked(t) for t in texts], pa.string())]

    return map_texts(df, keys, text, [T.StructField(out, T.StringType())], make)
