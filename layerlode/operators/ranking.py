"""Scores of terms for clusters: information weights, BM25, centrality. All layers and clusters at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerlode.functions.memory import tidy
from layerlode.functions.vectors import cosine_distance, mean_vectors, minus
from layerlode.operators.clustering import places
from layerlode.operators.grams import packed, unpacked
from layerlode.sources.store import written

#: Scores are rounded to so many digits before they rank, so that a sum's order can't change a rank.
DIGITS = 6


def class_counts(counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """(layer, cluster, term_id, c, s): occurrences in the cluster's objects, and the sum of ln(1 + n) over them.

    An object's cells move once, in one row, and are summed for all objects of the same clusters together.
    """
    own = places(assignments)
    cells = packed(counts).join(own.select("object_id", "kind").hint("shuffle_hash"), "object_id")
    alike = unpacked(cells, "kind").groupBy("kind", "term_id").agg(F.sum("n").alias("c"), F.sum(F.log1p("n")).alias("s"))
    every = alike.join(own.groupBy("kind").agg(F.first("places").alias("places")), "kind").select(F.explode("places").alias("p"), "term_id", "c", "s")
    return every.groupBy("p.layer", "p.cluster", "term_id").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def bm25(classes: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(layer, cluster, term_id, score) with clusters as documents: their length is the count of all their terms."""
    lengths = classes.groupBy("layer", "cluster").agg(F.sum("c").alias("dl"))
    layers = lengths.groupBy("layer").agg(F.count("*").alias("classes"), F.avg("dl").alias("avgdl"))
    sized = lengths.join(layers, "layer")
    own = classes.withColumn("df", F.count("*").over(Window.partitionBy("layer", "term_id"))).join(sized, ["layer", "cluster"])
    idf = F.log(1 + (F.col("classes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("c") / (k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl")) + F.col("c"))
    return own.select("layer", "cluster", "term_id", (tf * idf).alias("score"))


def information_weights(classes: DataFrame, prior: float = 0.1, power: float = 2.0) -> DataFrame:
    """(layer, term_id, weight): the divergence of a term's distribution over clusters from that of all terms.

    ``p(c) = (n_c + prior q(c)) / (n + prior)`` with q(c) the cluster's share of all counts; the weight is the sum over
    all clusters of ``p ln(p / q)``, to ``power``. Clusters without the term are summed in closed form.
    """
    totals = classes.groupBy("layer", "cluster").agg(F.sum("c").alias("t"))
    shares = totals.withColumn("q", F.col("t") / F.sum("t").over(Window.partitionBy("layer"))).select("layer", "cluster", "q")
    own = classes.join(shares, ["layer", "cluster"]).withColumn("n", F.sum("c").over(Window.partitionBy("layer", "term_id")))
    p = (F.col("c") + prior * F.col("q")) / (F.col("n") + prior)
    found = own.groupBy("layer", "term_id").agg(F.sum(p * F.log(p / F.col("q"))).alias("held"), F.sum("q").alias("covered"), F.first("n").alias("n"))
    empty = prior / (F.col("n") + prior)
    divergence = F.col("held") + F.greatest(1 - F.col("covered"), F.lit(0.0)) * empty * F.log(empty)
    return found.select("layer", "term_id", F.pow(F.greatest(divergence, F.lit(0.0)), power).alias("weight"))


def information_scores(classes: DataFrame, prior: float = 0.1, power: float = 2.0) -> DataFrame:
    """(layer, cluster, term_id, score): summed ln(1 + n) times the term's weight."""
    weights = information_weights(classes, prior, power)
    return classes.join(weights, ["layer", "term_id"]).select("layer", "cluster", "term_id", (F.col("s") * F.col("weight")).alias("score"))


def top_terms(scores: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(layer, cluster, rank, term_id, term, score): the ``n`` best positive scores of each cluster, ties by term."""
    own = scores.join(terms.select("term_id", "term"), "term_id").withColumn("score", F.round("score", DIGITS)).where("score > 0")
    order = Window.partitionBy("layer", "cluster").orderBy(F.desc("score"), "term")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("layer", "cluster", "rank", "term_id", "term", "score")


#: Bytes of the sums that a task holds before it sends them; cells whose vectors are weighed together; terms of a group.
SUMS_BYTES, CELLS, TERMS = 1 << 27, 1 << 11, 1024


class _Sums:
    """Sums of weighed vectors by term."""

    def __init__(self, dims: int):
        self.at, self.ids, self.weights, self.sums = np.full(0, -1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, dims))

    def add(self, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        """Of terms that differ."""
        if len(self.at) <= terms.max():
            self.at = np.append(self.at, np.full(max(int(terms.max()) + 1, 2 * len(self.at)) - len(self.at), -1))
        fresh = terms[self.at[terms] < 0]
        if len(fresh):
            self.at[fresh] = np.arange(len(self.ids), len(self.ids) + len(fresh))
            self.ids = np.append(self.ids, fresh)
            if len(self.ids) > len(self.sums):
                more = max(len(self.ids), 2 * len(self.sums)) - len(self.sums)
                self.weights, self.sums = np.append(self.weights, np.zeros(more)), np.concatenate([self.sums, np.zeros((more, self.sums.shape[1]))])
        slots = self.at[terms]
        self.weights[slots] += weights
        self.sums[slots] += vectors

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), TERMS):
            j = min(i + TERMS, len(self.ids))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * self.sums.shape[1]), pa.array(self.sums[i:j].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i:j]).cast(kind), pa.array(self.weights[i:j]), lists], names=["term_id", "weight", "vector"])


def _table(lists: pa.Array, rows: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if rows and len(flat) % rows:
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def term_vectors(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term_id, vector), written: the mean of the vectors of the objects that hold a term, by its count in them.

    An object's vector moves once, with all of its cells; tasks send sums for each term, not a vector for each cell.
    """
    cells = packed(counts)
    kind = cells.schema["term_ids"].dataType.elementType.simpleString()
    held = vectors.select("object_id", "embedding").where("embedding is not null")
    own = cells.join(held.hint("merge"), "object_id").select("term_ids", "ns", F.col("embedding").cast("array<double>").alias("embedding"))
    # Each task sends up to a row for each term, so there are as many as cores ask for, however large the tables are.
    own = own.coalesce(2 * cells.sparkSession.sparkContext.defaultParallelism)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, pa.int64()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _table(batch.column("embedding"), batch.num_rows)
            ids = batch.column("term_ids").flatten()
            out = ids.type
            terms, ns = ids.to_numpy(zero_copy_only=False), batch.column("ns").flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("term_ids")).to_numpy(zero_copy_only=False))
            order = np.argsort(terms)
            state = state or _Sums(x.shape[1])
            for i in range(0, len(order), CELLS):
                some = order[i : i + CELLS]
                first = np.flatnonzero(np.diff(terms[some], prepend=terms[some[0]] - 1))
                weights = ns[some].astype(np.float64)
                state.add(terms[some[first]].astype(np.int64), np.add.reduceat(weights, first), np.add.reduceat(x[rows[some]] * weights[:, None], first, axis=0))
            if state.sums.nbytes > SUMS_BYTES:
                yield from state.rows(out)
                state = None
        if state is not None:
            yield from state.rows(out)

    def means(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _table(pa.concat_arrays(table.column("vector").chunks), table.num_rows)
        terms, place = np.unique(table.column("term_id").to_numpy(), return_inverse=True)
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        weights = np.add.reduceat(table.column("weight").to_numpy()[order], first)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1, dtype=np.int32) * x.shape[1]), pa.array((np.add.reduceat(x[order], first, axis=0) / weights[:, None]).ravel()))
        return pa.Table.from_arrays([pa.array(terms), lists], names=["term_id", "vector"])

    parts = own.mapInArrow(tidy(sums), f"term_id {kind}, weight double, vector array<double>")
    found = parts.groupBy((F.col("term_id") / TERMS).cast("bigint").alias("_terms")).applyInArrow(means, f"term_id {kind}, vector array<double>")
    return written(found, "term_vectors")


def missing_vectors(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """The terms without a vector, or with one of no length: those to embed."""
    known = vectors.where(F.exists("vector", lambda x: x != 0)).select("term_id")
    return terms.join(known, "term_id", "left_anti")


def central_terms(classes: DataFrame, vectors: DataFrame, terms: DataFrame, n: int = 16) -> DataFrame:
    """(layer, cluster, rank, term_id, term, distance): the n x n terms of a cluster nearest to its mean term.

    Vectors are centred by the mean of all term vectors; the mean of a cluster weighs terms by their counts.
    """
    mean = mean_vectors(vectors, [], "vector").select(F.col("mean").alias("_all"))
    centred = vectors.crossJoin(F.broadcast(mean)).select("term_id", minus(F.col("vector"), F.col("_all")).alias("v"))
    own = classes.join(centred, "term_id")
    centres = mean_vectors(own, ["layer", "cluster"], "v", "c").select("layer", "cluster", F.col("mean").alias("centre"))
    far = own.join(centres, ["layer", "cluster"]).select("layer", "cluster", "term_id", F.round(cosine_distance(F.col("v"), F.col("centre")), DIGITS).alias("distance"))
    named = far.join(terms.select("term_id", "term"), "term_id")
    order = Window.partitionBy("layer", "cluster").orderBy("distance", "term")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n * n).select("layer", "cluster", "rank", "term_id", "term", "distance")
