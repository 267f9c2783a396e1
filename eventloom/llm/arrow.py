"""Arrow helpers of the operators that run in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker handles at a time.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of the batches with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give freed memory of this worker back to the system; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def strings(column: pa.Array) -> list[str]:
    """Python strings; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def flat_binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of raw bytes from a flat array of fixed-size items and item offsets."""
    flat = np.ascontiguousarray(flat)
    ends = (offsets.astype(np.int64) * flat.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)]
    ).cast(pa.binary())
