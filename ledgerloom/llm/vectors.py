"""Integer vectors for the operators over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factor by which components are scaled before they are rounded down.
SCALE = 256
#: Components of this size and more count as not finite: sums of products of scaled ones would not fit into 64 bits.
LARGEST = 2**18


def usable(vector: Column) -> Column:
    """True for vectors without null, non-finite or huge components; false for null vectors."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return F.coalesce(~bad, F.lit(False))


def scaled(rows: DataFrame, vec_col: str) -> Column:
    """The components of a usable vector times SCALE, in double, rounded down."""
    return F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def narrow(values: np.ndarray) -> np.ndarray:
    """values in the smallest signed type that holds them all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(kind)


def widened(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    """The matrix that narrow() wrote as bytes, in 64 bits; the width of a value follows from the length."""
    cells = shape[0] * shape[1]
    return np.frombuffer(data, f"i{len(data) // cells}").astype(np.int64).reshape(shape) if cells else np.zeros(shape, np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in 64-bit integers; through floating point where every sum fits its 53 bits, which is exact and faster."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).swapaxes(-1, -2)).astype(np.int64)
    return a @ b.swapaxes(-1, -2)
