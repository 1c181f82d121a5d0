"""Bounded memory in Python workers: parts of batches by bytes, and what is given back when a task ends."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker's caches: dropped when a task ends (workers live on and serve other queries).
CACHES: list[Callable[[], None]] = []
PART_BYTES, PART_ROWS = 1_500_000, 2000


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of the column and at most `rows` rows; a longer text is a part alone."""
    if not batch.num_rows:
        return
    kind = batch.schema.field(column).type
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind)):
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def released(caches: bool = True) -> None:
    """Gives freed memory back to the system; with `caches` the worker's caches first."""
    if caches:
        for clear in CACHES:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that releases what it has gathered when its rows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            released()

    return run
