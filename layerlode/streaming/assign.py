"""Beyond the batch engine: topics of objects as they arrive. Not part of what a batch fit does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.vectors import cosine_distance


def assign_nearest(arriving: DataFrame, centroids: DataFrame, layer: int = 0) -> DataFrame:
    """``arriving(object_id, embedding, ...)``, batch or stream, with the cluster of the nearest centroid of a layer.

    Centroids are as many as topics: they become one array, so a row is placed without a shuffle or state.
    """
    own = centroids.where(F.col("layer") == layer)
    side = F.broadcast(own.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_all")))
    vector = F.col("embedding").cast("array<double>")
    placed = F.array_min(F.transform("_all", lambda c: F.struct(F.round(cosine_distance(vector, c["centroid"]), 9).alias("distance"), c["cluster"].alias("cluster"))))
    out = arriving.crossJoin(side).withColumn("_p", placed)
    return out.select(*arriving.columns, F.lit(layer).alias("layer"), F.col("_p.cluster").alias("cluster"), F.col("_p.distance").alias("distance"))


def windowed_counts(placed: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, cluster, n) of each window; objects later than ``late`` behind the newest are let go."""
    own = placed.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "cluster").agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), "cluster", "n")
