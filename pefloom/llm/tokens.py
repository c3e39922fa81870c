"""Vectorised words of Arrow string columns: numpy over the UTF-8 buffer, no Python string per row.

A *word* is a maximal run of digits, ASCII letters (A-Z lower-cased) and bytes from 0x80 on, that is, of the
code points ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Words carry a 64-bit hash: a polynomial over
the word's bytes, taken from one running sum by inverse powers, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _word_table() -> np.ndarray:
    t = np.zeros(256, np.uint64)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            t[b] = mix(np.array([c + 1], np.uint64))[0] | np.uint64(1)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_TABLE = _word_table()
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
        for name, base in (("up", _MUL), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``most`` bytes, one row at least."""
    data, offs = buffer(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word, and the words' offsets by row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
    t = _TABLE[data]
    inside = t != 0
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    run = np.cumsum(t * up[:n], dtype=np.uint64)
    before = np.where(start > 0, run[start - 1], np.uint64(0))
    return mix((run[end - 1] - before) * down[start]), start, end, np.searchsorted(start, offs)


def rows_of(woffs: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))


def grams(h: np.ndarray, woffs: np.ndarray, n: int, step: int = 1, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words at i, i + step, ... of one row, and the word positions i."""
    span = (n - 1) * step
    if len(h) <= span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = rows_of(woffs)
    at = np.flatnonzero(row[: len(h) - span] == row[span:])
    out = np.full(len(at), salt * 2 + 1, np.uint64)
    for k in range(n):
        out = mix(out * _MUL + h[at + k * step])
    return out, at


def shingles(h: np.ndarray, woffs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's n-word shingles with repeats; a row of fewer words, but not none, has one of all its words."""
    out, at = grams(h, woffs, n)
    row = rows_of(woffs)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(woffs) < n) & (np.diff(woffs) > 0))
    if len(short):
        more = []
        for r in short:
            x = np.full(1, 7, np.uint64)
            for w in h[woffs[r] : woffs[r + 1]]:
                x = mix(x * _MUL + w)
            more.append(x[0])
        out, row = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row
