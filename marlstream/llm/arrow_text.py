"""Texts of an Arrow column as one NumPy byte array, without a Python object for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i has bytes[offsets[i]:offsets[i + 1]]; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        return utf8(column.cast(pa.string()))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches_of(table: pa.RecordBatch, column: str, most: int):
    """Slices of a batch whose texts have about `most` bytes; a longer text is a slice of its own."""
    _, offsets = utf8(table.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield table.slice(at, to - at)
        at = to
