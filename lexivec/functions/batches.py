"""Arrow batches in parts of bounded size, and their memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that a worker takes apart at a time; a longer text comes alone, and whole.
SLICE_BYTES = 2_500_000


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text size, each in buffers of its own."""
    texts = batch.column(column)
    if texts.nbytes <= most or len(texts) < 2:
        yield batch
        return
    sizes = np.cumsum(np.fromiter((len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts), np.int64, len(texts)))
    part = sizes // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.take(pa.array(np.arange(a, b)))


def tidy(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A batch function that hands its memory back at the end of a partition.

    Python workers live on between tasks and stages; what their allocators keep would count against
    the executor for as long.
    """

    @wraps(batches)
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(parts)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # not this C library

    return run
