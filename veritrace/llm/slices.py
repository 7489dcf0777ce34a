"""Bounded memory: Arrow columns of texts in slices, so that a batch of long texts is never held whole as Python strings, and freed memory given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice, unless a single text is longer.
BYTES = 4_000_000


def slices(b: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in that string column have at most so many bytes together."""
    x = b.column(column)
    if not len(x):
        return
    width = np.dtype(np.int64 if pa.types.is_large_string(x.type) else np.int32)
    ends = np.frombuffer(x.buffers()[1], width, len(x) + 1, x.offset * width.itemsize).astype(np.int64)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return what this process has freed to the machine: a fit's arrays are many and large, and the driver lives on after it."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; elsewhere freed memory goes back by itself
    if trim:
        trim(0)
