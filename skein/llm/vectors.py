"""Which vectors take part, and exact measures on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, not empty, all components finite and one not zero (never null)."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """The length that most usable vectors have (of ties the greater); others take no part. 0 without usable vectors."""
    sizes = df.filter(usable(column)).groupBy(F.size(column).alias("n")).count()
    return int(sizes.agg(F.max(F.struct("count", "n"))["n"]).first()[0] or 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length `dim`, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
