"""Words and windows of whole texts as arrays: one vectorised pass over the UTF-8 bytes of many texts.

The functions work inside Arrow tasks. A batch is cut into runs of whole texts of about a
megabyte, so memory follows the run and the longest single text, never the batch.
Hashes are polynomials over 64-bit integers with a random value for each byte, mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 20)) * U(0x9E3779B97F4A7C15))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd base and of its inverse, at least ``n`` of them."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * RUN_BYTES)
        base = int(constants(seed, 1)[0]) | 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, U(b), dtype=U)
            steps[0] = U(1)
            out.append(np.cumprod(steps, dtype=U))
        have = _POWERS[seed] = (out[0], out[1])
    return have


class Run:
    """Whole texts ``first`` to ``last`` of a batch: their bytes and where each begins."""

    def __init__(self, first: int, last: int, data: np.ndarray, starts: np.ndarray):
        self.first, self.last, self.data, self.starts = first, last, data, starts

    def words(self, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends and text number (within the run) of every word: maximal runs of ``word_byte``."""
        w = word_byte[self.data]
        if not len(w):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        before = np.empty_like(w)
        before[0], before[1:] = False, w[:-1]
        inner = self.starts[1:-1]
        inner = inner[inner < len(w)]
        before[inner] = False
        after = np.empty_like(w)
        after[-1], after[:-1] = False, w[1:]
        after[inner[inner > 0] - 1] = False
        begin, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        return begin, end, np.searchsorted(self.starts, begin, side="right") - 1

    def word_hashes(self, begin: np.ndarray, end: np.ndarray, seed: int = 1, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` maps bytes first, as from upper to lower case."""
        values = constants(seed + 100, 256)
        if fold is not None:
            values = values[fold]
        power, inverse = _powers(seed, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=U)
        np.cumsum(values[self.data] * power[: len(self.data)], out=total[1:], dtype=U)
        return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U))


def windows(hashes: np.ndarray, text_of: np.ndarray, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """First word number and hash of every ``size`` consecutive words of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    power, inverse = _powers(seed, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:], dtype=U)
    at = np.flatnonzero(text_of[:n] == text_of[size - 1 :])
    return at, mix((total[at + size] - total[at]) * inverse[at] + U(size))


def runs(texts: pa.Array, limit: int = RUN_BYTES):
    """Cuts a string column into runs of whole texts; NULL is read as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Run(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def byte_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``space``: all but blanks; ``alnum``: letters, digits and bytes beyond ASCII."""
    table = np.ones(256, dtype=bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
