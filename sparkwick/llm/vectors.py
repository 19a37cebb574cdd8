"""Which vectors of a table can be compared, for the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not zero, and no component null or not finite."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent length of the usable vectors (ties: the longer one); 0 if there are none."""
    sizes = df.where(usable(vector)).groupBy(F.size(vector).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of doubles as a list column."""
    offsets = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
