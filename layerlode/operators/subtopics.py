"""Topics of the finest layer that describe a cluster of a coarser one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerlode.functions.vectors import cosine_distance, mean_vectors, minus
from layerlode.operators.selection import diversify_at_least, similarities, submodular

METHODS = ("central", "central_from_all", "information_weighted", "saturated_coverage", "facility_location")
DIGITS = 6
_ROWS = "layer int, cluster int, rank int, sub_cluster int"


def co_occurring(assignments: DataFrame) -> DataFrame:
    """(layer, cluster, sub_cluster): clusters of layer 0 that share an object with a cluster of a higher layer."""
    own = assignments.where("cluster >= 0")
    low = own.where("layer = 0").select("object_id", F.col("cluster").alias("sub_cluster"))
    return own.where("layer > 0").join(low, "object_id").select("layer", "cluster", "sub_cluster").distinct()


def central_order(assignments: DataFrame, names: DataFrame, n: int = 64, from_all: bool = False) -> DataFrame:
    """(layer, cluster, rank, sub_cluster, distance): the n x n subtopics nearest to the mean of a cluster's subtopics.

    ``names(sub_cluster, v)``: vectors of the names of layer 0. They are centred by their mean unless ``from_all``,
    where all of layer 0 is ranked and not only what shares objects with the cluster.
    """
    own = names.where("sub_cluster >= 0")
    if not from_all:
        mean = mean_vectors(own, [], "v").select(F.col("mean").alias("_all"))
        own = own.crossJoin(F.broadcast(mean)).select("sub_cluster", minus(F.col("v"), F.col("_all")).alias("v"))
    pairs = co_occurring(assignments).join(own, "sub_cluster")
    centres = mean_vectors(pairs, ["layer", "cluster"], "v").select("layer", "cluster", F.col("mean").alias("centre"))
    ranked = centres.crossJoin(own) if from_all else pairs.join(centres, ["layer", "cluster"])
    far = ranked.withColumn("distance", F.round(cosine_distance(F.col("v"), F.col("centre")), DIGITS))
    order = Window.partitionBy("layer", "cluster").orderBy("distance", "sub_cluster")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n * n)


def owners(assignments: DataFrame) -> DataFrame:
    """(layer, sub_cluster, cluster): each subtopic belongs to one cluster of a layer, the last that it shares objects with."""
    return co_occurring(assignments).groupBy("layer", "sub_cluster").agg(F.max("cluster").alias("cluster"))


def code_positive(x: np.ndarray, atoms: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Non-negative lasso codes of rows over atoms, by coordinate descent on all rows at once."""
    gram, target = atoms @ atoms.T, x @ atoms.T
    codes = np.zeros((len(x), len(atoms)))
    for _ in range(rounds):
        for k in range(len(atoms)):
            if gram[k, k] > 0:
                rest = target[:, k] - codes @ gram[:, k] + codes[:, k] * gram[k, k]
                codes[:, k] = np.maximum(rest - penalty, 0) / gram[k, k]
    return codes


def dictionary(x: np.ndarray, most: int = 512, penalty: float = 0.1, rounds: int = 5) -> np.ndarray:
    """Atoms of unit length, begun with rows evenly spaced and updated one at a time."""
    n = max(1, min(most, len(x) // 2))
    atoms = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    atoms /= np.maximum(np.linalg.norm(atoms, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        codes = code_positive(x, atoms, penalty, 10)
        for k in range(n):
            used = codes[:, k] > 0
            if used.any():
                rest = x[used] - codes[used] @ atoms + codes[used, k : k + 1] * atoms[k]
                new = codes[used, k] @ rest
                length = np.linalg.norm(new)
                if length > 0:
                    atoms[k] = new / length
    return atoms


def _information(n: int, prior: float, power: float):
    """One layer: rows are subtopics with their cluster; all topics of a layer fit a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sub_cluster")
        x, owner = np.stack(rows["v"].to_numpy()), rows["cluster"].to_numpy()
        codes = code_positive(x, dictionary(x))
        kinds, at = np.unique(owner, return_inverse=True)
        sums = np.zeros((len(kinds), codes.shape[1]))
        np.add.at(sums, at, codes)
        q = sums.sum(axis=1, keepdims=True) / max(sums.sum(), 1e-12)
        p = (sums + prior * q) / (sums.sum(axis=0) + prior)
        weights = np.where(p > 0, p * np.log(np.where((p > 0) & (q > 0), p / np.maximum(q, 1e-300), 1)), 0).sum(axis=0).clip(0) ** power
        score = codes @ weights
        out = []
        for k, cluster in enumerate(kinds):
            own = np.flatnonzero(at == k)
            w = score[own] if score[own].sum() > 0 else np.ones(len(own))
            centre = w @ x[own] / w.sum()
            order = own[np.lexsort((own, -score[own]))][: n * n]
            kept = order[diversify_at_least(centre, x[order], n)][:n]
            out.append(pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": cluster, "rank": range(1, len(kept) + 1), "sub_cluster": rows["sub_cluster"].to_numpy()[kept]}))
        return pd.concat(out)

    return run


def _diverse(n: int, alpha: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        kept = diversify_at_least(np.asarray(rows["centre"].iloc[0]), np.stack(rows["v"].to_numpy()), n, alpha)[:n]
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(kept) + 1), "sub_cluster": rows["sub_cluster"].to_numpy()[kept]})

    return run


def _covering(n: int, function: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sub_cluster")
        kept = submodular(similarities(np.stack(rows["v"].to_numpy())), n, function) if len(rows) > n else list(range(len(rows)))
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(kept) + 1), "sub_cluster": rows["sub_cluster"].to_numpy()[kept]})

    return run


def subtopics(assignments: DataFrame, names: DataFrame, n: int = 16, method: str = "central", alpha: float = 1.0, prior: float = 0.1, power: float = 2.0) -> DataFrame:
    """(layer, cluster, rank, sub_cluster) for every cluster above layer 0, by ``method``; ``names(sub_cluster, v)``."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}; there are {', '.join(METHODS)}")
    if method == "information_weighted":
        return owners(assignments).join(names, "sub_cluster").groupBy("layer").applyInPandas(_information(n, prior, power), _ROWS)
    if method in ("central", "central_from_all"):
        ranked = central_order(assignments, names, n, method == "central_from_all")
        return ranked.groupBy("layer", "cluster").applyInPandas(_diverse(n, alpha), _ROWS)
    return co_occurring(assignments).join(names, "sub_cluster").groupBy("layer", "cluster").applyInPandas(_covering(n, method), _ROWS)


def summary_items(chosen: DataFrame, topics: DataFrame) -> DataFrame:
    """(layer, cluster, items): name, summary and explanation of each chosen subtopic, in order, as one text each."""
    low = topics.where("layer = 0").select(F.col("cluster").alias("sub_cluster"), F.concat_ws("\n", "name", "summary", "explanation").alias("item"))
    from layerlode.operators.phrases import ordered_lists

    return ordered_lists(chosen.join(low, "sub_cluster"), "item", "items")
