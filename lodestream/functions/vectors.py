"""Vector functions as SQL expressions, numpy kernels for bulk scoring, and a half-precision codec for columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of unequal length, empty or zero vectors, and nulls."""
    size = norm(a) * norm(b)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def relevance(similarity: Column) -> Column:
    """A cosine as a share between 0 and 1."""
    return (similarity + 1) / 2


def normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of dim numbers without nulls as the rows of a matrix, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _packed(vector: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, np.float64).astype("<f2").tobytes() for v in vector.to_pylist()], pa.binary())


def _unpacked(packed: pa.Array) -> pa.Array:
    return pa.array([None if b is None else np.frombuffer(b, "<f2", len(b) // 2).astype(np.float32) for b in packed.to_pylist()], pa.list_(pa.float32()))


def to_half(vector: Column | str) -> Column:
    """A vector as packed IEEE 754 binary16 numbers, two bytes each, little-endian."""
    return arrow_udf(_packed, BinaryType())(vector)


def from_half(packed: Column | str) -> Column:
    """Packed binary16 numbers as a vector; a last odd byte is left out."""
    return arrow_udf(_unpacked, ArrayType(FloatType()))(packed)
