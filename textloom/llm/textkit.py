"""Vectorised word scanning over Arrow string columns.

Every function here works on a whole block of documents at once with numpy, so that the
operators built on it never loop over characters or words in Python. Words are runs of
bytes other than space and 0x09-0x0D, lower-cased in A-Z only. A word, and any sequence of
words, is represented by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Gaps for words of letters and digits only: every other ASCII byte.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that one vectorised step handles; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def release() -> None:
    """Give freed memory back to the system, where the C library can; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _STEP), ("down", _BACK)):
            out = np.ones(size, dtype=np.uint64)
            filled, factor = 1, base
            while filled < size:
                take = min(filled, size - filled)
                out[filled : filled + take] = out[:take] * np.uint64(factor)
                filled, factor = filled + take, factor * factor % 2**64
            _powers[name] = out
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a block: `doc` is the row of each word, `first[i]:first[i+1]` the words of row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, rows) of consecutive slices with about `limit` bytes of text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.cumsum(size), 0
    while row < len(size):
        before = ends[row] - size[row]
        stop = max(int(np.searchsorted(ends, before + limit, side="right")), row + 1)
        yield row, stop - row
        row = stop


def scan(column: pa.Array, gaps: np.ndarray = _SPACE) -> Words:
    """All words of a block, in order, with their hashes; gaps: the bytes between words."""
    offsets, data = raw(column)
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none, np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    data = _LOWER[data]
    gap = gaps[data]
    head = ~gap
    tail = head.copy()
    solid = head.copy()
    head[1:] &= gap[:-1]
    tail[:-1] &= gap[1:]
    cut = offsets[:-1][offsets[:-1] < n]
    head[cut] |= solid[cut]
    cut = offsets[1:][offsets[1:] > 0] - 1
    tail[cut] |= solid[cut]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    if not len(start):
        return Words(data, start, end, doc, first, np.zeros(0, dtype=np.uint64))
    up, down = _power(n)
    value = _BYTE[data]
    value *= up[:n]
    value[gap] = 0
    return Words(data, start, end, doc, first, mix(np.add.reduceat(value, start) * down[start]))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one row, and the index of each run's first word."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(words.doc[:count] == words.doc[n - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        total += words.hash[at + k] * _ORDER[k]
    return mix(total), at


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row: (row of each member, hash, sizes by row).

    A row with fewer than n words has its whole sequence as the only shingle; a row
    without words has none. Members are sorted by row, then hash.
    """
    words = scan(column)
    rows = len(words.first) - 1
    value, at = grams(words, n)
    row = words.doc[at]
    length = np.diff(words.first)
    for size in range(1, n):
        short = np.flatnonzero(length == size)
        if len(short):
            total = np.zeros(len(short), dtype=np.uint64)
            for k in range(size):
                total += words.hash[words.first[short] + k] * _ORDER[k + 16 * size % 59]
            value, row = np.concatenate([value, mix(total + np.uint64(size))]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return row, value, np.bincount(row, minlength=rows)
