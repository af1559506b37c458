"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, a scan or what was made of one without a shuffle, over all cores if it has fewer partitions, else as it is.

    A small file is one row group and so one task, whatever the split size; costly expressions on it would use one core.
    Fewer partitions than cores hold no more than a split for each core, so little is moved however large the cluster.
    With ``by`` rows go by the hash of these columns, and aggregations by them need no other shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)
