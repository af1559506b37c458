"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.lit(1.0) - dot(a, b) / lengths).otherwise(F.lit(1.0))


def mean_vectors(df: DataFrame, by: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """(by..., mean, total): the weighted mean of a vector column; one buffer for each group, combined before it moves."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = df.where(F.col(vector).isNotNull())
    found = own.groupBy(*by).agg(Summarizer.mean(array_to_vector(F.col(vector)), w).alias("m"), F.sum(w).alias("total"))
    return found.select(*by, vector_to_array("m").alias("mean"), "total")
