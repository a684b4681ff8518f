"""Arrow batches in small pieces, for Python code whose results are many times
its input."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text and rows that are worked on at once
SLICE, MOST_ROWS = 1 << 20, 1_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `SLICE` bytes of a column and `MOST_ROWS` rows; a row
    is never cut."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(total, done + SLICE, side="right"))), at + MOST_ROWS)
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def small(run: Callable[[Iterator], Iterator], column: str) -> Callable[[Iterator], Iterator]:
    """`run` over slices of the batches.  A worker is kept for other tasks, so what
    it took is given back at the end."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(part for b in batches for part in slices(b, column))
        finally:
            release()

    return whole
