"""Vectors as rows of whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest and smallest value of a long; exact results beyond them become these.
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only."""

    def finite(entry: Column) -> Column:
        wide = entry.cast("double")
        return wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def scaled(table: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """key (long) and ``x``, the array of floor(scale * entry) as longs (the nearest long where none holds it), of the usable rows."""
    entries = F.transform(vector, lambda entry: F.floor(entry.cast("double") * F.lit(float(scale))))
    return table.filter(usable(F.col(vector))).select(F.col(key).cast("long").alias(key), entries.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of arrays of ``width`` longs as a matrix."""
    flat = column.flatten() if len(column) else pa.array([], pa.int64())
    return np.asarray(flat, dtype=np.int64).reshape(len(column), width)


def to_long(values: np.ndarray) -> np.ndarray:
    """Python integers as longs; those beyond a long become the nearest one."""
    return np.array([min(max(int(v), LONG_MIN), LONG_MAX) for v in values.ravel()], np.int64).reshape(values.shape)


def largest(x: np.ndarray) -> int:
    """The largest absolute value as a Python integer (also of the smallest long)."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
