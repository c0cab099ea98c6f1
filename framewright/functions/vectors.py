"""Vector similarity over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matrix(column: pa.ListArray, dim: int, rows: np.ndarray) -> np.ndarray:
    """The chosen rows of a list column, all of length dim, as doubles."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = column.offsets.to_numpy()[:-1][rows]
    return flat[starts[:, None] + np.arange(dim)]


@F.arrow_udf(T.DoubleType())
def cosine_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosine of two vectors; null where it cannot be computed.

    Rows of one length are scored together as a matrix, straight from the Arrow
    buffers. A null, a zero vector or unequal lengths give null.
    """
    left_len = left.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right_len = right.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    result = np.full(len(left), np.nan)
    usable = (left_len == right_len) & (left_len > 0)
    for dim in np.unique(left_len[usable]):
        rows = np.flatnonzero(usable & (left_len == dim))
        a = _matrix(left, int(dim), rows)
        b = _matrix(right, int(dim), rows)
        norms = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            result[rows] = (a * b).sum(axis=1) / norms
    return pa.array(result, mask=~np.isfinite(result))
