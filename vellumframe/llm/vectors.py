"""Usable vectors of a table, and numpy access to them in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero, and holds finite components only."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def common_length(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent vector length (0 without rows); vectors of other lengths are compared with nothing."""
    row = vectors.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, length) of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
