"""What the operators on embeddings share: finite vectors, their integer form, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products of this size are exact as doubles; greater ones have no certain floor.
MOST_EXACT = 2.0**53


def finite(vector: Column) -> Column:
    """Whether a vector is given and no component is null or non-finite; an empty one has none."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def floors(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift as long, components taken as doubles; an error where a product is 2^53 or more."""

    def whole(x: Column) -> Column:
        product = scale * x.cast("double")
        return F.when(F.abs(product) < MOST_EXACT, F.floor(product) + shift).otherwise(F.raise_error(F.lit("a component is too large for an exact integer")))

    return F.transform(vector, whole).cast("array<bigint>")


def matrix(lists: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
