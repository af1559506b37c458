"""Keyphrases of clusters: ranked candidates, collapsed to the longest, then diversified or chosen to cover."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.vectors import mean_vectors
from layerlode.operators.ranking import bm25, central_terms, class_counts, information_scores, top_terms
from layerlode.operators.selection import collapse_longest, diversify_at_least, similarities, submodular
from layerlode.schemas import NO_KEYPHRASES
from layerlode.sources.store import written

METHODS = ("information_weighted", "central", "bm25", "saturated_coverage", "facility_location", "graph_cut")
_ROWS = "layer int, cluster int, rank int, term string"


def _select(n: int, least: float, tolerance: float, alpha: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        names = collapse_longest(rows["term"].tolist())
        held = dict(zip(rows["term"], rows["vector"], strict=True))
        own = [t for t in names if held[t] is not None]
        if own:
            x = np.stack([np.asarray(held[t], dtype=float) for t in own])
            names = [own[i] for i in diversify_at_least(np.asarray(rows["query"].iloc[0], dtype=float), x, n, alpha, least, tolerance)]
        names = names[:n]
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(names) + 1), "term": names})

    return run


def _cover(n: int, function: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        terms = rows["term"].to_numpy()
        if len(rows) > n:
            x = np.stack([np.asarray(v, dtype=float) for v in rows["vector"]])
            cost = 1 - rows["score"].to_numpy() / (0.01 + rows["score"].max())
            terms = terms[submodular(similarities(x), n, function, cost)]
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(terms) + 1), "term": terms})

    return run


def candidates(counts: DataFrame, assignments: DataFrame, terms: DataFrame, vectors: DataFrame, n: int = 16, method: str = "information_weighted") -> DataFrame:
    """(layer, cluster, rank, term_id, term, score) before any selection, cut to what the selection looks at."""
    classes = written(class_counts(counts, assignments), "class_counts")
    if method == "central":
        return central_terms(classes, vectors, terms, n).withColumn("score", 1 - F.col("distance")).drop("distance")
    if method == "bm25":
        return top_terms(bm25(classes), terms, n * n)
    if method == "information_weighted":
        return top_terms(information_scores(classes), terms, max(4 * n, 16))
    return top_terms(information_scores(classes, prior=0.01), terms, n * n)


def keyphrases(counts: DataFrame, assignments: DataFrame, terms: DataFrame, vectors: DataFrame, n: int = 16, method: str = "information_weighted", alpha: float = 1.0) -> DataFrame:
    """(layer, cluster, rank, term) of every cluster by ``method``; ``vectors(term_id, vector)``.

    A cluster none of whose terms scores has one row with a phrase that says so.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}; there are {', '.join(METHODS)}")
    found = candidates(counts, assignments, terms, vectors, n, method).join(vectors, "term_id", "left")
    if method in ("saturated_coverage", "facility_location", "graph_cut"):
        held = found.where("vector is not null")
        mean = F.broadcast(mean_vectors(vectors, [], "vector").select(F.col("mean").alias("_all")))
        held = held.crossJoin(mean).withColumn("vector", F.zip_with("vector", "_all", lambda x, y: x - y)).drop("_all")
        chosen = held.groupBy("layer", "cluster").applyInPandas(_cover(n, method), _ROWS)
    else:
        centre = mean_vectors(found.withColumn("w", F.greatest("score", F.lit(1e-9))), ["layer", "cluster"], "vector", "w").select("layer", "cluster", F.col("mean").alias("query"))
        least, tolerance = (0.5, 0.1) if method == "information_weighted" else (0.0, 0.01)
        chosen = found.join(centre, ["layer", "cluster"], "left").groupBy("layer", "cluster").applyInPandas(_select(n, least, tolerance, alpha), _ROWS)
    every = assignments.where("cluster >= 0").select("layer", "cluster").distinct()
    return every.join(chosen, ["layer", "cluster"], "left").select("layer", "cluster", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("term", F.lit(NO_KEYPHRASES)).alias("term"))


def longest_only(ranked: DataFrame) -> DataFrame:
    """``ranked(layer, cluster, rank, term)`` with phrases collapsed to the longest that hold them, ranked anew."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = collapse_longest(rows.sort_values("rank")["term"].tolist())
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "cluster": rows["cluster"].iloc[0], "rank": range(1, len(names) + 1), "term": names})

    return ranked.select("layer", "cluster", "rank", "term").groupBy("layer", "cluster").applyInPandas(run, _ROWS)


def ordered_lists(ranked: DataFrame, value: str, name: str) -> DataFrame:
    """(layer, cluster, ``name`` array) of a ranked table."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("x"))))
    return ranked.groupBy("layer", "cluster").agg(F.transform(items, lambda s: s["x"]).alias(name))



