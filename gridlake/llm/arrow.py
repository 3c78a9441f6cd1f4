"""Helpers for functions that run over Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20


def texts(column: pa.Array) -> pa.Array:
    """The column as large strings that begin at 0, null as the empty text.

    A slice is copied: string kernels of Arrow read a cast slice from the wrong place.
    """
    if column.offset:
        column = pa.concat_arrays([column])
    return column.cast(pa.large_string()).fill_null("")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of large strings, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
        sizes = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes + 64) - 1) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()
