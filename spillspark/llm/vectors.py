"""What the vector operators share: which rows take part, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Sums of products of as many as 2**12 components below this bound are exact in 64 bits.
LIMIT = float(1 << 24)


def usable(vector: Column) -> Column:
    """True where a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, as array<int>; an error beyond ``LIMIT``."""
    scaled = lambda x: F.floor(SCALE * x.cast("double"))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < LIMIT / SCALE, scaled(x)).otherwise(F.raise_error(F.lit("a component is too large for exact sums"))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long lists as a matrix; another length is an error."""
    n = np.asarray(column.value_lengths())
    if len(n) and (n != width).any():
        raise ValueError(f"vectors of {width} components and of others")
    return np.asarray(column.flatten()).reshape(len(column), width)


def flat(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def width_of(rows: DataFrame, column: str = "v") -> int | None:
    """Components of the vectors, by the first; None without rows."""
    first = rows.select(F.size(column).alias("w")).first()
    return first.w if first else None
