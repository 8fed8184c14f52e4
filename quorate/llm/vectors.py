"""Reading of vector columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable, matrix) of a column of number lists: rows in double precision, short ones padded with zeros.

    NULL vectors and those with NULL or non-finite components are not usable; their rows of the matrix are zeros.
    """
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=bool), np.zeros((0, 0))
    usable = np.asarray(column.is_valid())
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if n else 0
    if (lengths == width).all():
        out = values.reshape(n, width).copy()
    else:
        out = np.zeros((n, width))
        row = np.repeat(np.arange(n), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    bad = ~np.isfinite(out).all(axis=1)
    usable &= ~bad
    out[~usable] = 0
    return usable, out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """The matrix with zeros up to ``width`` columns, or cut to it where the rest is never multiplied by anything but zero."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))
