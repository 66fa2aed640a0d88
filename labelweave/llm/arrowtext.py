"""Texts of Arrow batches as byte arrays, cut into runs of bytes that are hashed together.

Everything here works on whole batches with numpy; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SLICE_BYTES = 4 << 20

_LONGEST = 64
_random = np.random.default_rng(20240607)
#: A random number for every byte value at each of the first 64 places of a run.
_PLACED = _random.integers(0, 2**64, (_LONGEST, 256), dtype=np.uint64)
#: Odd factors of the words of a shingle.
_ODD = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and the ``n + 1`` offsets of its rows; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes, or one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64 bits so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges ``starts[i]:ends[i]``, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    short = np.minimum(lengths, _LONGEST + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    longer = len(starts) - np.cumsum(np.bincount(short, minlength=_LONGEST + 2))
    total, at = np.zeros(len(starts), np.uint64), starts[order]
    for place in range(_LONGEST):  # by place, over all runs that reach it
        reached = int(longer[place])
        if not reached:
            break
        total[:reached] += _PLACED[place][data[at[:reached] + place]]
    result = np.empty_like(total)
    result[order] = total
    for run in np.flatnonzero(lengths > _LONGEST):
        rest = data[starts[run] + _LONGEST : ends[run]]
        place = np.arange(_LONGEST, _LONGEST + len(rest))
        value = _PLACED[place % _LONGEST, rest]
        value *= (2 * (place // _LONGEST) + 1).astype(np.uint64)
        result[run : run + 1] += value.sum(dtype=np.uint64)
    return mix(result + lengths.astype(np.uint64) * _ODD[0])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word: bytes between ASCII white space, A-Z in lower case."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[row_starts] = inside[1:-1][row_starts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stops = inside[1:-1] & ~inside[2:]
    row_ends = offsets[1:][offsets[1:] > 0] - 1
    stops[row_ends] = inside[1:-1][row_ends]
    ends = np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, hash_runs(_LOWER[data], starts, ends)


def shingles(
    rows: np.ndarray, word_hashes: np.ndarray, n_rows: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, row by row in order, and ``n_rows + 1`` bounds.

    A row of fewer words has one shingle of all its words; one without words has none.
    """
    per_row = np.bincount(rows, minlength=n_rows).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(per_row)))
    total = len(word_hashes)
    count = np.where(per_row >= size, per_row - size + 1, np.minimum(per_row, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    if not total:
        return np.zeros(0, np.uint64), bounds
    padded = np.concatenate((word_hashes, np.zeros(size, np.uint64)))
    whole = padded[:total] * _ODD[1]
    for k in range(1, size):
        whole = whole + padded[k : total + k] * _ODD[1 + k]
    whole = mix(whole)
    at = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], count) + np.repeat(first[:-1], count)
    found = whole[at]
    for n in range(1, size):
        of_n = np.flatnonzero(per_row == n)
        if len(of_n):
            value = np.full(len(of_n), n, np.uint64) * _ODD[40]
            for k in range(n):
                value += word_hashes[first[of_n] + k] * _ODD[1 + k]
            found[bounds[of_n]] = mix(value)
    return found, bounds
