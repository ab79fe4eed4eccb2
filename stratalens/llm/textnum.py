"""Words, hashes and byte classes of Arrow text columns, with numpy.

Everything works on the UTF-8 bytes of many texts at once, so a task's cost is
a handful of array operations per megabyte rather than Python calls per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a block of its own.
BLOCK = 300_000
BLOCK_ROWS = 4096
#: Bytes of one text whose words are hashed at once.
LONG = 4_000_000

_ODD = 0x9E3779B97F4A7C15
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything that is neither a digit, a letter nor part of a multi-byte character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

_powers: list[np.ndarray] = []


def tidy() -> None:
    """Hand freed memory back to the system: a worker lives on for other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


_LETTERS = _letters()
_LOWER_LETTERS = _LETTERS[_lower]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 65536)
        inverse = pow(_ODD, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.full(n, np.uint64(b), np.uint64)) for b in (_ODD, inverse)]
    return _powers[0], _powers[1]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into blocks of about ``size`` bytes: (rows, bytes, offsets).

    Null texts count as empty.  Offsets have one entry more than rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_binary(col.type):
            col = col.cast(pa.large_string()) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = min(max(end, start + 1), start + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
    tidy()


def words(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-delimiters; none crosses a text's end."""
    inside = ~delimiter[data]
    begins, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] |= inside[heads]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    tails = heads[heads > 0]
    ends[tails] |= inside[tails - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (ascending and apart), A-Z as a-z if ``lower``; a very long text is taken piece by piece."""
    if len(data) > LONG and len(start):
        heads = np.unique(np.append(0, np.searchsorted(start, np.arange(LONG, len(data), LONG))))
        heads = heads[heads < len(start)]
        return np.concatenate([_word_hashes(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a], lower) for a, b in zip(heads, [*heads[1:], len(start)], strict=True)])
    return _word_hashes(data, start, end, lower)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER_LETTERS if lower else _LETTERS)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]) if len(start) else np.zeros(0, np.uint64)


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words within a row; a row with fewer, but some, words gives one run of all."""
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    n = len(hashes) - width + 1
    if n > 0:
        out = np.zeros(n, np.uint64)
        for k, f in enumerate(factors):
            out += hashes[k : k + n] * f
        full = row[:n] == row[width - 1 :]
        out, owner = out[full], row[:n][full]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    counts = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += hashes[first[has] + k] * factors[k]
        extra += counts[short].astype(np.uint64) * np.uint64(_ODD)  # apart from longer runs
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    return mix(out), owner


def distinct_per_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs in that order."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], row[keep]
