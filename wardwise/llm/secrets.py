"""Secret scanning through nested encodings: a worklist of decoded layers for each text."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm.common import without

#: Kinds in their listed order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# Bytes written as escapes, with printable ones left as they are.
ESCAPED = (("%", re.compile(r"x?%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[!#-$&-~])*"), "url"), ("\\x", re.compile(r"x?\\x[0-9A-Fa-f]{2}(?:\\x[0-9A-Fa-f]{2}|[!#-\[\]-~])*"), "unicode"))
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/]{16,})*(\r?\n[A-Za-z0-9+/]+)?={0,2}")
URLSAFE = str.maketrans("-_", "+/")
#: Compressed streams are inflated in pieces of at most this many bytes.
PIECE = 1 << 20
#: Inflated bytes are scanned in windows of about this size, each with the last OVERLAP bytes of the one before.
WINDOW = 4 << 20
OVERLAP = 1 << 16
#: Bytes that no encoding spans: a window ends after one, or after four NULs (single ones are within UTF-16).
BREAK = np.ones(256, dtype=bool)
BREAK[[0x00, 0x0A, 0x0D, *range(0x21, 0x7F)]] = False
#: Steps in a row that a path spells out.
LONG = 8
FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,path:string>>"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def _longer(path: tuple, step: str) -> tuple:
    """A decoding path with one more step: steps with how often each is taken in a row, so that deep nesting has a short path."""
    if path and path[-1][0] == step:
        return (*path[:-1], (step, path[-1][1] + 1))
    return (*path, (step, 1))


def _written(path: tuple) -> str:
    """The steps one after another; a step taken over LONG times in a row once, with its number."""
    return "/".join("/".join([step] * n) if n <= LONG else f"{step}*{n}" for step, n in path)


class Layer:
    """Decoded text, and for each of its characters where it begins and ends in the original."""

    def __init__(self, text: str, begin: np.ndarray | None, end: np.ndarray | None, path: tuple):
        self.text, self.begin, self.end, self.path = text, begin, end, path

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (int(self.begin[a:b].min()), int(self.end[a:b].max()))

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begin is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.begin, self.end


def _replaced(layer: Layer, pattern: re.Pattern, decode, step: str) -> Layer | None:
    """The layer with each match decoded in place; ``decode`` gives characters and how much of the match each takes."""
    begin, end = layer.maps()
    texts, begins, ends, last = [], [], [], 0
    for m in pattern.finditer(layer.text):
        parts = decode(m)
        if parts is None:
            continue
        texts.append(layer.text[last : m.start()])
        begins.append(begin[last : m.start()])
        ends.append(end[last : m.start()])
        at = m.start()
        for char, width in parts:
            texts.append(char)
            begins.append(begin[at : at + 1])
            ends.append(end[at + width - 1 : at + width])
            at += width
        last = m.end()
    if not last:
        return None
    texts.append(layer.text[last:])
    begins.append(begin[last:])
    ends.append(end[last:])
    return Layer("".join(texts), np.concatenate(begins), np.concatenate(ends), _longer(layer.path, step))


def _percent(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + n].decode("utf-8"), 3 * n))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append((chr(raw[i]), 3))
            i += 1
    return out


def _escape(m: re.Match):
    hexed = m[1] or m[2] or m[3] or m[4] or m[5]
    code = int(hexed, 16) if hexed else int(m[6])
    return [(chr(code), len(m[0]))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _decompressor(raw: bytes):
    """A reader of the compressed stream that ``raw`` seems to begin with, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 6 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    return None


def _broken(error: Exception) -> bool:
    return isinstance(error, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)) or type(error).__name__ == "ZstdError"


def _member(d, pieces, left: list):
    """The output of one compressed stream in bounded pieces; ``left`` gets the bytes behind it."""
    bounded = isinstance(d, type(zlib.decompressobj()))
    data = b""
    while True:
        if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
            if not data and d.needs_input:
                data = next(pieces, b"")
                if not data:
                    return
            out, data = d.decompress(data, PIECE), b""
        elif bounded:
            data = d.unconsumed_tail or next(pieces, b"")
            if not data:
                if out := d.flush():
                    yield out
                return
            out = d.decompress(data, PIECE)
        else:  # zstandard bounds its output by its input only: one block of at most 128 KB each
            data = next(pieces, b"")
            if not data:
                return
            for i in range(0, len(data), 1 << 10):
                if out := d.decompress(data[i : i + (1 << 10)]):
                    yield out
                if d.eof:
                    left.append(d.unused_data + data[i + (1 << 10) :])
                    return
            continue
        if out:
            yield out
        if d.eof:
            left.append(d.unused_data)
            return


def _inflated(pieces):
    """What all streams of ``pieces`` hold, one after another, in bounded pieces; bytes that are no stream follow as they are."""
    pieces = iter(pieces)
    head = next(pieces, b"")
    while head:
        while len(head) < 16 and (more := next(pieces, b"")):
            head += more
        padded = head.lstrip(b"\0")  # between gzip members and between xz streams
        d = _decompressor(padded)
        if d is None:
            yield head
            yield from pieces
            return
        left: list[bytes] = []
        try:
            yield from _member(d, itertools.chain([padded], pieces), left)
        except Exception as error:
            if not _broken(error):
                raise
            yield padded
        head = left[0] if left else b""
        head = head or next(pieces, b"")


def _stream(raw: bytes) -> bool:
    """Whether a compressed stream that holds something begins here."""
    return _decompressor(raw) is not None and not raw.startswith(next(_inflated([raw]), b""))


def _cut(raw: bytes):
    for i in range(0, len(raw), PIECE):
        yield raw[i : i + PIECE]


def _windows(pieces):
    """Overlapping windows that end where no encoding goes on. One without such a place grows: nothing is left out."""
    held, looked = bytearray(), 0
    for piece in pieces:
        held += piece
        if len(held) < WINDOW:
            continue
        looked = max(looked, OVERLAP)
        last = np.flatnonzero(BREAK[np.frombuffer(bytes(held[looked:]), dtype=np.uint8)])
        end = max(looked + int(last[-1]) + 1 if len(last) else 0, held.rfind(b"\0\0\0\0", looked) + 4)
        if end <= looked + 3:
            looked = max(looked, len(held) - 3)
            continue
        yield bytes(held[:end])
        del held[: max(0, end - OVERLAP)]
        looked = 0
    if held:
        yield bytes(held)


def _texts(raw: bytes):
    """The bytes as text: UTF-8, or else Latin-1 as all patterns are ASCII; and without NULs if many are in it, as in UTF-16."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    yield text
    if 4 * text.count("\0") >= len(text):
        yield text.replace("\0", "")


def _plain(raw: bytes) -> bool:
    """Whether all bytes are printable text, so that they were meant to be read whole."""
    try:
        text = raw.decode("utf-16-le" if raw[1::2].count(0) * 2 > 0.9 * len(raw) else "utf-8")
    except UnicodeDecodeError:
        return False
    return all(c.isprintable() or c in "\t\r\n" for c in text)


def _unbase64(layer: Layer, m: re.Match):
    """Layers in one run of base64 characters: read whole, and unless that is a stream or printable, in its parts between
    slashes, dashes and underscores as well. A short last line may be prose after the run, so the lines before it are also read alone."""
    pieces = [(m.start(), m.end())]
    tried = set()
    while pieces:
        a, b = pieces.pop()
        if (a, b) in tried:
            continue
        tried.add((a, b))
        body = "".join(layer.text[a:b].split()).rstrip("=").translate(URLSAFE)
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            raw = b""
        if raw:
            yield from _from_bytes(layer, raw, a, b, "base64")
        if not raw or not (_stream(raw) or _plain(raw)):
            if m[1]:
                pieces.append((m.start(), m.start(1)))
            pieces += [(a + p.start(), a + p.end()) for p in re.finditer(r"[A-Za-z0-9+=\s]{16,}", layer.text[a:b]) if p.end() - p.start() < b - a]


def _from_bytes(layer: Layer, raw: bytes, a: int, b: int, step: str):
    """Layers of decoded bytes: at their places as they are, at the place of the whole run what compressed streams in them hold."""
    begin, end = layer.maps()
    path = _longer(layer.path, step)
    low, high = begin[a:b].min(), end[a:b].max()

    def whole(text: str, path: tuple) -> Layer:
        return Layer(text, np.broadcast_to(low, len(text)), np.broadcast_to(high, len(text)), path)

    if not _stream(raw):
        for text in _texts(raw):
            if len(text) == len(raw):
                chars = np.array([i for i in range(a, b) if not layer.text[i].isspace()])
                i = np.arange(len(text))
                first = chars[np.minimum(i * 4 // 3, len(chars) - 1)]
                last = chars[np.minimum((i * 8 + 7) // 6, len(chars) - 1)]
                yield Layer(text, begin[first], end[last], path)
            else:
                yield whole(text, path)
        return
    pieces, seen = _cut(raw), set()
    while True:
        # As much as a window is looked at; if that is all, it is inflated again without a chain of readers.
        head, size = [], 0
        while size < WINDOW and (piece := next(pieces, b"")):
            head.append(piece)
            size += len(piece)
        start = b"".join(head)
        mark = hashlib.sha1(start).digest()
        if _decompressor(start) is None or mark in seen:  # a stream that holds itself
            break
        seen.add(mark)
        pieces, path = _inflated(itertools.chain(_cut(start), pieces)), _longer(path, "inflate")
    for window in _windows(itertools.chain([start], pieces)):
        for text in _texts(window):
            yield whole(text, path)


def _escaped_streams(layer: Layer):
    """What compressed streams hold that are written as runs of percent or hex escapes."""
    for mark, pattern, step in ESCAPED:
        if mark not in layer.text:
            continue
        for m in pattern.finditer(layer.text):
            raw = re.sub(re.escape(mark).encode() + rb"([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), m[0].encode())
            # A zlib stream begins with an x, which may be written as it is, or belong to the word before another stream.
            for skip in (0, 1) if raw[:1] == b"x" else (0,):
                if _stream(raw[skip:]):
                    yield from _from_bytes(layer, raw[skip:], m.start() + skip, m.end(), step)


def _runs(layer: Layer):
    """Layers of encoded runs within a layer."""
    yield from _escaped_streams(layer)
    for m in BASE64.finditer(layer.text):
        yield from _unbase64(layer, m)


def _whole(layer: Layer) -> list[Layer]:
    """The layer with all escapes of one sort decoded in place."""
    out = []
    if "%" in layer.text:
        out.append(_replaced(layer, PERCENT, _percent, "url"))
    if "\\" in layer.text or "&#" in layer.text:
        out.append(_replaced(layer, ESCAPE, _escape, "unicode"))
    return [x for x in out if x]


def _taken(layers: list[Layer]):
    """The layers one by one, each let go of when it is handed on."""
    while layers:
        yield layers.pop(0)


def find_secrets(text: str) -> tuple[list[dict], int]:
    """All spans with the decoding path of each, and the number of layers read."""
    work, seen, spans, layers = [iter([Layer(text, None, None, ())])], set(), {}, 0
    while work:
        layer = next(work[-1], False)
        if layer is False:
            work.pop()
        if not layer:
            continue
        key = (hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.place(0, len(layer.text)) if layer.text else None)
        if key in seen:  # a cycle, or a layer reached in two ways
            continue
        seen.add(key)
        layers += 1
        for kind, a, b in scan(layer.text):
            spans.setdefault((*layer.place(a, b), kind), layer.path)
        # The runs first: when they have been read, the layer is let go, and layers decoded as a whole do not pile up however deep they are nested.
        work.append(_taken(_whole(layer)))
        work.append(_runs(layer))
        del layer
    ordered = sorted(spans, key=lambda s: (s[0], s[2], s[1]))
    return [{"kind": KINDS[k], "start": a, "end": b, "base": not spans[(a, b, k)], "path": _written(spans[(a, b, k)])} for a, b, k in ordered], layers


def _rows(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("path", pa.string())]))
    for batch in batches:
        found, layers = [], []
        for text in batch.column(1):
            spans, n = find_secrets(text.as_py() or "")
            found.append(spans)
            layers.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, kind), pa.array(layers, pa.int32())], names=["row", "secrets", "layers"]
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with secrets (array of kind, start, end, base, path) and layers.

    Every text is scanned as it is (base spans) and again in each layer that decoding gives: percent escapes
    and Unicode escapes are decoded in the whole layer, base64 runs and the compressed streams in them become
    layers of their own. New layers are decoded again until none is new; a layer equal to one already read at the same
    place is skipped, so cycles end. Spans are in code points of the original text, end exclusive, sorted by start, kind and end;
    a span in a compressed layer is the whole encoded run. Compressed streams are read to their end, all members, in overlapping windows, each a layer.
    Every decoded layer is scanned, whatever its bytes. ``layers`` counts those read (1: nothing encoded).
    NULL and empty texts have no secrets; repeated rows each get their own result; no shuffle is needed.
    """
    docs = without(docs, "secrets", "layers")
    names = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.struct(F.lit(0).alias("none")).alias("row")
    columns = docs.select(row, F.col("text").cast("string").alias("text"))
    kind = columns.schema["row"].dataType.simpleString()
    out = columns.mapInArrow(_rows, f"row {kind}, secrets {FOUND}, layers int")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "secrets", "layers")
