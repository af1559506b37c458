"""Relational operators on layers of clusters: sizes, centroids, the tree, sizes of the next layer, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.functions.vectors import mean_vectors
from layerlode.sources.store import written


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """(layer, cluster, size) from 0 to each layer's last label, labels without members included; noise isn't counted."""
    counted = assignments.where("cluster >= 0").groupBy("layer", "cluster").agg(F.count("*").alias("size"))
    every = counted.groupBy("layer").agg(F.max("cluster").alias("last")).select("layer", F.explode(F.sequence(F.lit(0), "last")).alias("cluster"))
    return every.join(counted, ["layer", "cluster"], "left").select("layer", "cluster", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def centroids(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(layer, cluster, centroid, size): means of ``vectors(object_id, embedding)``, all layers at once."""
    members = assignments.where("cluster >= 0").join(vectors.select("object_id", "embedding"), "object_id")
    return mean_vectors(members, ["layer", "cluster"], "embedding").select("layer", "cluster", F.col("mean").alias("centroid"), F.col("total").cast("bigint").alias("size"))


def null_topic(vectors: DataFrame) -> DataFrame:
    """One row: the mean of all vectors, of noise too."""
    return mean_vectors(vectors, [], "embedding").select(F.col("mean").alias("null_topic"))


def cluster_tree(assignments: DataFrame) -> DataFrame:
    """Edges of the tree: a cluster's parent is the nearest higher layer's least cluster that shares an object with it.

    Clusters without one hang on the root (number of layers, 0).
    """
    own = assignments.where("cluster >= 0")
    top = assignments.agg((F.max("layer") + 1).cast("int").alias("top"))
    low = own.select("object_id", F.col("layer").alias("child_layer"), F.col("cluster").alias("child_cluster"))
    up = own.select("object_id", F.col("layer").alias("l"), F.col("cluster").alias("c"))
    pairs = low.join(up, "object_id", "left").withColumn("p", F.when(F.col("l") > F.col("child_layer"), F.struct("l", "c")))
    parents = pairs.groupBy("child_layer", "child_cluster").agg(F.min("p").alias("p")).crossJoin(F.broadcast(top))
    return parents.select(F.coalesce("p.l", "top").alias("parent_layer"), F.coalesce("p.c", F.lit(0)).alias("parent_cluster"), "child_layer", "child_cluster")


def places(assignments: DataFrame) -> DataFrame:
    """(object_id, places, kind), written: all (layer, cluster) of each clustered object as one array, and a number for it;
    layers that nest have few."""
    own = assignments.where("cluster >= 0").groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("layer", "cluster"))).alias("places"))
    return written(own.withColumn("kind", F.xxhash64("places")), "places")


def next_min_cluster_size(assignments: DataFrame, quantile: float = 0.8) -> DataFrame:
    """(layer, next_size): the quantile of the layer's cluster sizes, cut to an integer."""
    sizes = assignments.where("cluster >= 0").groupBy("layer", "cluster").count()
    return sizes.groupBy("layer").agg(F.floor(F.percentile("count", F.lit(quantile))).cast("bigint").alias("next_size"))


def relabel(assignments: DataFrame, min_clusters: int = 1, max_layers: int | None = None) -> DataFrame:
    """Contiguous labels in each layer in the order of the old ones, noise kept; layers with fewer than
    ``min_clusters`` clusters go, at most ``max_layers`` stay, and layers are renumbered from 0."""
    known = assignments.where("cluster >= 0").select("layer", "cluster").distinct()
    known = known.withColumn("new", (F.row_number().over(Window.partitionBy("layer").orderBy("cluster")) - 1).cast("int"))
    layers = known.groupBy("layer").agg(F.count("*").alias("k")).where(F.col("k") >= min_clusters)
    layers = layers.withColumn("new_layer", (F.row_number().over(Window.orderBy("layer")) - 1).cast("int"))
    if max_layers is not None:
        layers = layers.where(F.col("new_layer") < max_layers)
    kept = assignments.join(layers.select("layer", "new_layer"), "layer")
    return kept.join(known, ["layer", "cluster"], "left").select("object_id", F.col("new_layer").alias("layer"), F.coalesce("new", F.lit(-1)).alias("cluster"))


def k_means_layers(vectors: DataFrame, base_clusters: int = 1024, min_clusters: int = 6, seed: int = 1) -> DataFrame:
    """(object_id, layer, cluster): k-means with ``base_clusters`` centres, then a quarter as many, down to ``min_clusters``.

    No more centres than vectors are asked for. Vectors are written once, so that no round makes them anew.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = written(spread(written(vectors.select("object_id", "embedding"), "points")).select("object_id", array_to_vector("embedding").alias("features")), "features")
    n = own.count()
    found, layer, k = None, 0, min(base_clusters, n)
    while k >= max(min_clusters, 1):
        model = KMeans(k=k, seed=seed + layer, maxIter=20).fit(own) if k > 1 else None
        labels = model.transform(own).select("object_id", F.col("prediction").alias("cluster")) if model else own.select("object_id", F.lit(0).alias("cluster"))
        labels = labels.select("object_id", F.lit(layer).alias("layer"), F.col("cluster").cast("int").alias("cluster"))
        found = labels if found is None else found.unionByName(labels)
        layer, k = layer + 1, k // 4
    if found is None:
        raise ValueError(f"fewer than {min_clusters} vectors to cluster")
    return relabel(written(found, "labels"))
