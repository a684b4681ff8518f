"""Whole Arrow batches of text as flat arrays: words, word hashes, lines.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  These are all
ASCII, so cutting UTF-8 bytes gives the same words as cutting code points.
Everything here works on one batch and keeps no state.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 256
#: bytes of text that are worked on at once: arrays of 8 bytes a byte are made of them
SLICE = 1 << 18
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(_LONG, 0x9E3779B97F4A7C15, np.uint64))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE):
    """Cuts a batch into runs of rows with about `limit` bytes of `column`."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for a worker that is kept for other tasks: what its arrays took is
    given back when it ends, as idle workers count in an executor's memory."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets in them; null is empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside` that don't cross a row."""
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words."""
    return runs(~_SPACE[data], offsets)


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each start lies."""
    return np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] for disjoint ascending spans of at
    least one byte.  Spans of 256 bytes and more take a cryptographic hash, as
    a polynomial is weak on long crafted strings."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    total = int(at[-1] + lengths[-1])
    if total == len(data):
        own = data
    else:
        step = np.ones(total, np.int64)
        step[0] = starts[0]
        step[at[1:]] = starts[1:] - ends[:-1] + 1
        own = data[np.cumsum(step)]
    if lower:
        own = _LOWER[own]
    place = np.arange(total) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_POWER[np.minimum(place, _LONG - 1)] * (own.astype(np.uint64) + np.uint64(1)), at)
        h = mix(h ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    for k in np.flatnonzero(lengths >= _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(own[at[k] : at[k] + lengths[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def windows(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `width` words from each word on, and whether all of them lie
    in the word's row."""
    n = len(h)
    if n < width:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    m = n - width + 1
    with np.errstate(over="ignore"):
        part = h[:m].copy()
        for k in range(1, width):
            part = mix(part * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    out[:m] = part
    whole = np.zeros(n, bool)
    whole[:m] = rows[:m] == rows[width - 1 :]
    return out, whole


def code_points(data: np.ndarray) -> np.ndarray:
    """True on each byte that begins a code point."""
    return (data & 0xC0) != 0x80
