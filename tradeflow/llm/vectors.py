"""Integer vectors shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null and every component a finite number; null or false otherwise."""
    return F.forall(F.col(vector).cast("array<double>"), lambda x: F.abs(x) < F.lit(float("inf")))


def floored(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; one that no int holds is an error."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("int"))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as integers, shorter ones continued by zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    if (sizes == width).all():
        return values[ends[0] : ends[-1]].astype(np.int64).reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values[ends[0] : ends[-1]]
    return out
