"""Connected components of an edge table, by union-find where it is small and by star contraction where it isn't."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.llm.common import DRIVER_ROWS, materialise


def _union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component), by hooking and pointer jumping on whole arrays."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        if (ru == rv).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]


def connected_components(edges: DataFrame, driver_rows: int = DRIVER_ROWS) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its least node.

    Up to ``driver_rows`` edges are united on the driver. More are contracted by alternating large-star and small-star
    rounds (Kiveris et al., 2014), each a group-by whose result is written to the shared folder; both ways give the
    same rows. Edges with a null end and loops add nothing.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    if edges.limit(driver_rows + 1).count() <= driver_rows:
        pairs = edges.toPandas()
        nodes, least = _union_find(pairs["a"].to_numpy("int64"), pairs["b"].to_numpy("int64"))
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"node": nodes, "component": least}), "node bigint, component bigint")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each node's larger neighbours are tied to the least of its neighbourhood.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = materialise(large, "star")
        # Small star: each node and its smaller neighbours are tied to the least of them.
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(low, large["b"] == low["n"]).select(F.col("m").alias("x"), F.col("a").alias("y"))
        edges = small.union(low.select(F.col("m").alias("x"), F.col("n").alias("y"))).where("x <> y")
        edges = materialise(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "star")
        # Sums of hashes would do; a count with the sum of ends is exact enough to see a fixed point.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
