"""Words and their 64-bit hashes for whole batches of texts, by numpy.

A text is taken as UTF-8 bytes.  All separators used here are ASCII, so cutting
at bytes never splits a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once; bounds the temporary arrays, not the texts.
SLICE_BYTES = 1 << 20


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true for the bytes in the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words ``[^\x20\x09-\x0D]+``.
WHITE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PLAIN = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of substrings of a sequence, from prefix sums of ``value * base**i`` modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = self.powers(base, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the odd base and of its inverse."""
        got = cls._powers.get(base)
        if got is None or len(got[0]) < n:
            size = max(n, SLICE_BYTES + 1)
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, U64)
                p[0] = 1
                pair.append(np.cumprod(p, dtype=U64))
            got = cls._powers[base] = tuple(pair)
        return got[0][:n], got[1][:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


_BYTE_BASE, _WORD_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTE_VALUES = (_table(11), _table(12))


def rolling_bytes(data: np.ndarray, which: int = 0) -> Rolling:
    return Rolling(_BYTE_VALUES[which][data], _BYTE_BASE[which])


def rolling_words(h: np.ndarray, which: int = 0) -> Rolling:
    return Rolling(h if which == 0 else mix(h + U64(0x632BE59BD9B4E019)), _WORD_BASE[which])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES):
    """Runs of rows (a, b) of at most ``size`` bytes, or of one longer row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of a batch of texts in order.

    ``hash`` is one hash a word, ``first[i]:first[i + 1]`` are the words of text
    ``i``, ``row`` is the text of each word.
    """

    def __init__(self, column, sep: np.ndarray = WHITE, lower: bool = False):
        data, off = utf8(column)
        hashes, counts = [], []
        for a, b in slices(off):
            part, edge = data[off[a] : off[b]], off[a : b + 1] - off[a]
            if lower:
                part = LOWER[part]
            inside = ~sep[part]
            cut = np.zeros(len(part) + 1, bool)
            cut[edge] = True
            before = np.zeros(len(part) + 1, bool)
            before[1:] = inside
            after = np.zeros(len(part) + 1, bool)
            after[:-1] = inside
            start = np.flatnonzero(after & (~before | cut))
            end = np.flatnonzero(before & (~after | cut))
            hashes.append(rolling_bytes(part).of(start, end))
            counts.append(np.diff(np.searchsorted(start, edge)))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.zeros(len(self.count) + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def starts(self, k: int) -> np.ndarray:
        """Where ``k`` words of one text begin."""
        at = np.arange(len(self.hash))
        return at[at + k <= self.first[1:][self.row]] if len(at) else at

    def position(self, at: np.ndarray) -> np.ndarray:
        """Word number inside its text."""
        return at - self.first[self.row[at]]


def runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals [start, end) by row."""
    if not len(row):
        return row, start, end
    o = np.lexsort((start, row))
    row, start, end = row[o], start[o], end[o]
    # ends never fall within a row once they are running maxima; rows are kept apart by a large step
    step = np.int64(end.max() + 2)
    s, e = start + row * step, np.maximum.accumulate(end + row * step)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(s)) - 1
    return row[at], start[at], e[last] - row[at] * step
