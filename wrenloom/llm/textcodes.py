"""Vectorised word codes over Arrow string columns.

A *word* is a maximal run of bytes other than the six ASCII blanks (space, tab, newline, vertical tab, form feed,
carriage return). Everything works on the UTF-8 bytes of the column, so no Python string is made per row or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = (x * base) & _MASK
    return out


_POW = powers(_BASE, 256)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the entropy of h over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    offsets = raw.astype(np.int64)
    data = col.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose text has about `most` bytes each; a longer row comes alone, and whole."""
    if not batch.num_rows:
        return
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of several rows: byte span, row and 64-bit code of each, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        if not n:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.code = np.zeros(0, np.uint64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        solid = ~BLANK[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begin[edges] |= solid[edges]  # rows are adjacent in the buffer, yet a word never crosses rows
        at = np.flatnonzero(solid)
        self.start = np.flatnonzero(begin)
        ranks = np.cumsum(begin)[at] - 1
        firsts = np.searchsorted(at, self.start)
        lengths = np.diff(np.append(firsts, len(at)))
        self.end = self.start + lengths
        within = at - self.start[ranks]
        longest = int(lengths.max()) if len(lengths) else 0
        table = _POW if longest <= len(_POW) else powers(_BASE, longest)
        letters = data[at]
        if lower:
            letters = LOWER[letters]
        value = (letters.astype(np.uint64) + np.uint64(1)) * table[within]
        self.code = mix(np.add.reduceat(value, firsts)) if len(firsts) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """The code of the n words from each position; the last n-1 positions are left out."""
    m = len(code) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j, p in enumerate(powers(0xD6E8FEB86659FD93, n)):
        out += code[j : j + m] * p
    return mix(out)
