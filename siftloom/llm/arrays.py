"""NumPy helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def release() -> None:
    """Give freed memory back, so that idle workers stay small beside their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (int64, from 0); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8)
    return body, at - at[0]


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    if len(sizes) == 0:
        return
    block = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(block, block[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    release()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start+length-1 of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """String (or ``kind``) array over existing bytes; ``offsets`` may not skip bytes."""
    return pa.Array.from_buffers(
        kind or pa.string(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
