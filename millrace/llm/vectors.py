"""What the operators on whole-number vectors share: floors of scaled components, and their rows as arrays of numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sums of products below this are exact in doubles; beyond it integers are used, which numpy multiplies without BLAS.
EXACT = 1 << 53


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null and holds neither nulls nor components that are not finite."""
    wide = lambda x: x.cast("double")
    return vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == float("inf"))))


def floored(vectors: DataFrame, scale: int, vector: str, name: str) -> tuple[DataFrame, int, int]:
    """The rows with `x`, floor(scale * component) of their vectors, and a number `row`, written; x's greatest length and size.

    Raises where a product of two vectors, or a squared distance, is beyond 64 bits.
    """
    kept = finite(vectors, vector)
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    most = F.max(F.array_max(F.transform(vector, lambda c: F.abs(c.cast("double")))))
    about = kept.agg(F.max(F.size(vector)).alias("width"), most.alias("most")).first()
    width, most = about["width"] or 0, int((about["most"] or 0.0) * scale) + 1
    if 4 * most * most * max(width, 1) >= 1 << 63:
        raise ValueError(f"components of up to {about['most']:g} are too large for whole-number scores of 64 bits")
    kind = "array<int>" if most < 1 << 31 else "array<bigint>"
    rows = kept.withColumn("x", scaled.cast(kind)).withColumn("row", F.monotonically_increasing_id())
    return written(rows, name), width, most


def grid(column: pa.Array | pa.ChunkedArray, width: int, kind=np.int64) -> np.ndarray:
    """Lists of numbers as rows of one array, shorter ones ending in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width).astype(kind)
    size = np.array(column.value_lengths().to_pylist(), np.int64)
    out = np.zeros((len(column), width), kind)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
