"""Integer vectors out of a column of arrays, shared by compression and search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs; what is beyond a long becomes its nearest end."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def padded(vector: Column, width: int) -> Column:
    """Zeros behind, up to `width` components."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def integers(rows: DataFrame, vector: str, scale: int, **keep: str) -> DataFrame:
    """Usable rows as `v` (array of longs) and the columns of `keep` (new name: column)."""
    x = F.col(vector).cast("array<double>")
    return rows.filter(usable(x)).select(*[F.col(c).alias(n) for n, c in keep.items()], scaled(x, scale).alias("v"))


def width_of(rows: DataFrame) -> int:
    """Components of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size("v")).alias("w")).first().w or 0


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column, all of `width` components, as an int64 matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), width)
