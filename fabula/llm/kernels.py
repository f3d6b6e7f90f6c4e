"""Vectorised byte kernels over Arrow string columns.

All kernels read the column's buffers in place and work in slices of bounded
size, so memory does not follow the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

_PRIME = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def string_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return offsets, data


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows that hold at most ``most`` bytes, or one long row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, rows: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the number of words of each row.

    rows: offsets of the rows within data, from 0 to len(data).  A word is a run
    without ASCII white space, or with ``letters`` a run of letters (ASCII or
    beyond); it never crosses a row.
    """
    inside = _LETTER[data] if letters else ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, rows))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the spans, ASCII letters folded; spans in order of start.

    Hashed in pieces of bounded size, whatever the length of data.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi]
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE_CODE[_LOWER[part] if lower else part] * up[:-1], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out)


def shingle_sets(data: np.ndarray, rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row of the slice the sorted distinct hashes of its word shingles.

    A row of fewer than ``width`` words gives one shingle of all its words; a
    row without words gives none.
    """
    starts, ends, counts = word_spans(data, rows)
    words = span_hashes(data, starts, ends)
    at = np.concatenate([[0], np.cumsum(counts)])
    joined = words.copy()
    n = len(words)
    for k in range(1, min(width, n)):
        joined[: n - k] = mix(joined[: n - k] * _U(0xD6E8FEB86659FD93) + words[k:])
    for r in range(len(counts)):
        a, b = at[r], at[r + 1]
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            h = words[a : a + 1]
            for k in range(1, b - a):
                h = mix(h * _U(0xD6E8FEB86659FD93) + words[a + k : a + k + 1])
            yield mix(h ^ _U(b - a))
        else:
            yield words[:0]
