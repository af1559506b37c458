"""What the two vector searches share: clean vectors, one for each id, and arrays out of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): the least vector of each id. Null ids, null or empty vectors and vectors with a null, NaN or
    infinite element are left out."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    big = F.lit(float("inf")).cast(kind)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    own = own.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & good)
    return own.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in float64; zero rows stay."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    x = x / np.where(most > 0, most, 1)  # so that no square overflows or vanishes
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)
