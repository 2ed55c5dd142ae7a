"""Vectors as they come in tables: which take part, and how they travel as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, and all components finite numbers."""
    return F.coalesce(F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def by_length(column: pa.Array):
    """(dimension, row numbers, matrix in double precision) for each length of vector in a column of lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[start[rows][:, None] + np.arange(d)]
