"""Vectorised views of Arrow text batches.

Every operator that looks at words, lines or n-grams works on the UTF-8 bytes
of an Arrow column, without making a Python string per row.  A ``Texts`` holds
the bytes of a slice of rows end to end; nulls are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once by the numpy kernels; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


#: A random odd weight for each byte value, and the powers of an odd base.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * len(_powers), 1024), np.uint64(_BASE))
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


class Texts:
    """Rows of text as one byte array. ``off[i]:off[i + 1]`` are row i's bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.n = len(off) - 1

    def __len__(self) -> int:
        return self.n

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        raw = [(t or "").encode() for t in texts]
        off = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) for r in raw], out=off[1:])
        return cls(np.frombuffer(b"".join(raw), dtype=np.uint8), off)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a number for each byte, by row."""
        total = np.zeros(len(per_byte) + 1, dtype=np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def n_chars(self) -> np.ndarray:
        return self.sums((self.data & 0xC0) != 0x80)

    def row_text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """Maximal runs of bytes that aren't ASCII white space, and a 64-bit hash of each."""

    def __init__(self, texts: Texts, lower: bool = False):
        data = texts.data
        self.texts = texts
        word = ~_WS[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = texts.off[:-1][texts.off[:-1] < len(data)]
        first[heads] |= word[heads]
        self.start = np.flatnonzero(first)
        self.inside = word
        #: index of the first word of each row, and one past the last
        self.row_off = np.searchsorted(self.start, texts.off)
        self.count = np.diff(self.row_off)
        self._data = _LOWER[data] if lower else data

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def hashes(self) -> np.ndarray:
        return segment_hashes(self._data, self.start, self.inside)


def segment_hashes(data: np.ndarray, start: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the kept bytes of each segment; a segment ends where the next begins."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    tail = data[start[0] :]
    length = np.diff(np.append(start, len(data)))
    at = np.arange(len(tail)) - np.repeat(start - start[0], length)
    value = _BYTE[tail] * powers(int(length.max()))[at]
    if keep is not None:
        value[~keep[start[0] :]] = 0
    return mix64(np.add.reduceat(value, start - start[0]))


def windows(word_hash: np.ndarray, row_off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that stay in one row, and the first word of each."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        h *= np.uint64(_BASE)
        h += word_hash[k : n - size + 1 + k]
    last = np.repeat(row_off[1:], np.diff(row_off))[: n - size + 1]
    at = np.flatnonzero(np.arange(n - size + 1) + size <= last)
    return mix64(h[at]), at


def row_keys(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash that also tells rows apart."""
    return mix64(h ^ mix64((rows.astype(np.uint64) + np.uint64(1)) * _STEP))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, one past the last, Texts) for runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if column.null_count:
        # a null may still own bytes; move its neighbours' bytes together
        valid = np.asarray(column.is_valid())
        length = np.where(valid, np.diff(off), 0)
        if (length != np.diff(off)).any():
            keep = np.repeat(valid, np.diff(off))
            raw = raw[off[0] : off[-1]][keep]
            off = np.concatenate([[0], np.cumsum(length)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, Texts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j
