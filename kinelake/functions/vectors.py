"""Arrow list columns as padded numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as float64, NaN where a list is null, null or short.

    Longer lists are cut to ``width``; without one the longest list counts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.empty(0)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.full((n, width), np.nan)
    if len(values) and width:
        rows = np.repeat(np.arange(n), lengths)
        at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = at < width
        out[rows[keep], at[keep]] = values[keep]
    return out
