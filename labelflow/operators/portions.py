"""Portions of Arrow batches: what a task holds in Python objects follows from these limits, and not from the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 512
BYTES = 1 << 20


def bounds(text: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` of consecutive portions: at most ``rows`` texts and, where that is more than one, ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, end - at
        at = end


def portions(batch: pa.RecordBatch, text: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, cut by the lengths of its column ``text``."""
    for at, n in bounds(batch[text], rows, size):
        yield batch.slice(at, n)


def row_portions(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
