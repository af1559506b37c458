"""Objects that stand for a cluster: central and diverse, random, or chosen to cover it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerlode.functions.vectors import cosine_distance, dot, mean_vectors, minus, norm
from layerlode.operators.clustering import centroids, null_topic
from layerlode.operators.selection import FUNCTIONS, diversify_at_least, similarities, submodular

DIGITS = 6
#: Members of a cluster, in the order of a hash, among which a covering choice is made at most.
MOST_MEMBERS = 16_384
METHODS = ("central", "random_diverse", "random", *FUNCTIONS)


def _hash(seed: str):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col("object_id").cast("string")))


def distances_to_centroid(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(layer, cluster, object_id, distance, v, centre): cosine distance to the centroid, both less the mean of all."""
    mean = F.broadcast(null_topic(vectors))
    centres = centroids(assignments, vectors).crossJoin(mean).select("layer", "cluster", minus(F.col("centroid"), F.col("null_topic")).alias("centre"))
    own = assignments.where("cluster >= 0").join(vectors.select("object_id", "embedding"), "object_id").crossJoin(mean)
    own = own.select("layer", "cluster", "object_id", minus(F.col("embedding"), F.col("null_topic")).alias("v"))
    joined = own.join(centres, ["layer", "cluster"])
    return joined.select("layer", "cluster", "object_id", F.round(cosine_distance(F.col("v"), F.col("centre")), DIGITS).alias("distance"), "v", "centre")


def central_candidates(assignments: DataFrame, vectors: DataFrame, n: int = 4) -> DataFrame:
    """The max(n x n, 16) members of each cluster nearest to its centroid, with their rank; ties by id."""
    order = Window.partitionBy("layer", "cluster").orderBy("distance", "object_id")
    found = distances_to_centroid(assignments, vectors)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(n * n, 16))


def random_exemplars(assignments: DataFrame, n: int = 4, seed: str = "s") -> DataFrame:
    """(layer, cluster, rank, object_id) by a hash of seed and id: the same choice each time, in any engine."""
    order = Window.partitionBy("layer", "cluster").orderBy(_hash(seed), "object_id")
    own = assignments.where("cluster >= 0").withColumn("rank", F.row_number().over(order))
    return own.where(F.col("rank") <= n).select("layer", "cluster", "rank", "object_id")


def medoids(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(layer, cluster, object_id, total): the member with the largest sum of cosines to all members, the first choice of
    a facility location. The sum is one product with the sum of unit vectors, so no pair of members is formed."""
    own = assignments.where("cluster >= 0").join(vectors.select("object_id", "embedding"), "object_id")
    unit = own.withColumn("_n", norm(F.col("embedding"))).where("_n > 0")
    unit = unit.select("layer", "cluster", "object_id", F.transform("embedding", lambda x: x / F.col("_n")).alias("u"))
    sums = mean_vectors(unit, ["layer", "cluster"], "u")
    total = F.round(dot(F.col("u"), F.col("mean")) * F.col("total"), DIGITS)
    order = Window.partitionBy("layer", "cluster").orderBy(F.desc("total"), "object_id")
    scored = unit.join(sums, ["layer", "cluster"]).select("layer", "cluster", "object_id", total.alias("total"))
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


_ROWS = "layer int, cluster int, rank int, object_id bigint"


def _diverse(n: int, alpha: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        kept = diversify_at_least(np.array(rows["centre"].iloc[0]), np.stack(rows["v"].to_numpy()), n, alpha)[:n]
        ids = rows["object_id"].to_numpy()[kept]
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(ids) + 1), "object_id": ids})

    return run


def _covering(n: int, function: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("object_id")
        x = np.stack(rows["v"].to_numpy())
        kept = submodular(similarities(x), n, function) if len(rows) > n else list(range(len(rows)))
        ids = rows["object_id"].to_numpy()[kept]
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(ids) + 1), "object_id": ids})

    return run


def exemplars(assignments: DataFrame, vectors: DataFrame, n: int = 4, method: str = "central", alpha: float = 1.0, seed: str = "s", most_members: int = MOST_MEMBERS) -> DataFrame:
    """(layer, cluster, rank, object_id) by ``method``; clusters without members have no rows.

    central: nearest to the centroid, then diversified. random_diverse: a random order, diversified. random: as it says.
    facility_location, saturated_coverage, graph_cut: greedy covering of the cluster, of at most ``most_members``
    members in a hashed order. What reaches Python is ranked and cut first.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}; there are {', '.join(METHODS)}")
    if method == "random":
        return random_exemplars(assignments, n, seed)
    if method == "central":
        return central_candidates(assignments, vectors, n).groupBy("layer", "cluster").applyInPandas(_diverse(n, alpha), _ROWS)
    found = distances_to_centroid(assignments, vectors)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("layer", "cluster").orderBy(_hash(seed), "object_id")))
    if method == "random_diverse":
        return ranked.where(F.col("rank") <= max(n * n, 16)).groupBy("layer", "cluster").applyInPandas(_diverse(n, alpha), _ROWS)
    return ranked.where(F.col("rank") <= most_members).groupBy("layer", "cluster").applyInPandas(_covering(n, method), _ROWS)
