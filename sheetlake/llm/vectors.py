"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the rows that hold exactly ``width`` components, none null or non-finite.

    Null lists, lists of another length and lists with a null, NaN or infinite component are left out.
    Values are doubles, one row of the matrix per row number.
    """
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    sized = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == width)
    rows = np.flatnonzero(sized)
    flat = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    values = flat[offsets[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def blobs(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary value."""
    values = np.ascontiguousarray(values)
    step = values.shape[1] * values.itemsize if values.ndim > 1 else values.itemsize
    offsets = pa.py_buffer((np.arange(len(values) + 1) * step).astype(np.int64))
    wide = pa.Array.from_buffers(pa.large_binary(), len(values), [None, offsets, pa.py_buffer(values)])
    return wide.cast(pa.binary())


def unblobbed(column: pa.Array, dtype: np.dtype | str, width: int) -> np.ndarray:
    """The matrix of a binary column written by ``blobs``."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    if data is None:
        return np.zeros((len(column), width), dtype)
    part = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(part.tobytes(), dtype).reshape(-1, width)
