"""Near-duplicate embeddings by product quantisation (Jégou, Douze and Schmid, 2011) with an exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.llm.common import bounded_sample, materialise, split_by_size
from layerlode.llm.components import connected_components
from layerlode.llm.vectors import clean_vectors, matrix, unit

THRESHOLD = 0.9
#: Lists that a vector is looked for in; subspaces, code words in each; rounds of k-means, each over all vectors.
PROBES, SUBSPACES, WORDS, ROUNDS = 24, 8, 256, 5
#: Members of a list, and of those looked for in it, that one task compares; longer ones are cut.
CHUNK = 2048


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i : i + CHUNK] @ centres.T, axis=1) for i in range(0, len(x), CHUNK)] or [np.zeros(0, dtype=np.int64)])


@dataclass
class Codebooks:
    coarse: np.ndarray  # lists x dimensions
    words: list[np.ndarray]  # for each subspace: words x its dimensions
    cuts: list[int]

    def encode(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance from the coded vector, the ``probes`` nearest lists) of unit vectors."""
        far = (self.coarse**2).sum(axis=1) / 2 - x @ self.coarse.T
        n = min(probes, len(self.coarse))
        order = np.argpartition(far, n - 1, axis=1)[:, :n]
        home = np.argmin(far, axis=1)
        rest = x - self.coarse[home]
        codes = np.stack([nearest(rest[:, a:b], w) for w, a, b in zip(self.words, self.cuts, self.cuts[1:], strict=False)], axis=1).astype(np.uint8)
        left = rest - np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)
        return home, codes, np.sqrt((left**2).sum(axis=1)), order

    def scores(self, queries: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric: products of whole queries with coded vectors, summed from a table for each subspace."""
        out = (queries @ self.coarse.T).astype(np.float32)[:, home]
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            out += (queries[:, a:b] @ self.words[m].T).astype(np.float32)[:, codes[:, m]]
        return out


def _add(sums: np.ndarray, counts: np.ndarray, near: np.ndarray, x: np.ndarray) -> None:
    order = np.argsort(near, kind="stable")
    first = np.flatnonzero(np.diff(near[order], prepend=-1))
    sums[near[order][first]] += np.add.reduceat(x[order], first, axis=0)
    counts += np.bincount(near, minlength=len(counts))


def _coarse_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: np.ndarray = shared.value
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
        for batch in batches:
            x = unit(matrix(batch.column(0)))
            if len(x):
                _add(sums, counts, nearest(x, centres), x)
        yield _summed(0, sums, counts)

    return run


def _word_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        sums = [np.zeros_like(w) for w in books.words]
        counts = [np.zeros(len(w), dtype=np.int64) for w in books.words]
        for batch in batches:
            x = unit(matrix(batch.column(0)))
            if not len(x):
                continue
            rest = x - books.coarse[nearest(x, books.coarse)]
            for m, (a, b) in enumerate(zip(books.cuts, books.cuts[1:], strict=False)):
                _add(sums[m], counts[m], nearest(rest[:, a:b], books.words[m]), rest[:, a:b])
        for m in range(len(sums)):
            yield _summed(m, sums[m], counts[m])

    return run


def _summed(m: int, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    held = np.flatnonzero(counts)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums[held].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), m, dtype=np.int32)), pa.array(held.astype(np.int32)), pa.array(counts[held]), lists], names=["m", "k", "n", "sums"])


def _moved(vectors: DataFrame, run) -> dict[int, list[tuple[int, np.ndarray]]]:
    """New centres by subspace: sums of tasks are added up before the driver gets a row for each centre."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = vectors.select("v").mapInArrow(run, "m int, k int, n bigint, sums array<double>")
    sums = parts.groupBy("m", "k").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("s"))
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in sums.select("m", "k", "n", vector_to_array("s").alias("s")).collect():
        out.setdefault(r["m"], []).append((r["k"], np.array(r["s"]) / r["n"]))
    return out


def fit_codebooks(vectors: DataFrame, count: int, lists: int, subspaces: int = SUBSPACES, words: int = WORDS, rounds: int = ROUNDS) -> Codebooks:
    """Coarse centres of the ``count`` unit vectors ``vectors(node, v)``, then code words of the residuals in each run of
    dimensions: Lloyd's rounds over all vectors, from those that come first in the order of a hash. A centre that loses
    its vectors stays where it was."""
    context = vectors.sparkSession.sparkContext
    start = unit(matrix(bounded_sample(vectors, max(lists, words), F.xxhash64("node"), count).select("v").toArrow().column("v")))
    coarse = start[:lists].copy()
    for _ in range(rounds if len(coarse) > 1 else 1):
        for k, centre in _moved(vectors, _coarse_sums(context.broadcast(coarse))).get(0, []):
            coarse[k] = centre
    cuts = np.linspace(0, start.shape[1], min(subspaces, start.shape[1]) + 1).astype(int).tolist()
    rest = (start - coarse[nearest(start, coarse)])[:words]
    books = Codebooks(coarse, [rest[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)], cuts)
    for _ in range(rounds):
        for m, moved in _moved(vectors, _word_sums(context.broadcast(books))).items():
            for k, centre in moved:
                books.words[m][k] = centre
    return books


def _encode(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
            home, codes, error, order = books.encode(unit(matrix(batch.column(1))), probes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error.astype(np.float32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(home) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel().astype(np.int32))),
                    batch.column(1),
                ],
                names=["node", "home", "codes", "error", "probes", "v"],
            )

    return run


def _codes(rows: pa.Table) -> np.ndarray:
    held = rows.column("codes").to_pylist()
    return np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), -1)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(shared, threshold: float):
    """A forest over the pairs of a list's members that reach the threshold: of one chunk, or between two.

    Each member reached is a query whose look-up tables give its product with the codes of all not yet reached; those
    that could reach the threshold are compared exactly, so no pair that could join two components is left out.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        books: Codebooks = shared.value
        coarse = books.coarse[key[0].as_py()]
        i, j = key[1].as_py(), key[2].as_py()
        ids, x, codes, error = rows.column("node").to_numpy(), unit(matrix(rows.column("v"))), _codes(rows), rows.column("error").to_numpy()
        side = rows.column("chunk").to_numpy()
        edges: list[tuple[int, int]] = []
        left = np.arange(len(ids))
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                one = queue.pop()
                score = np.full(len(left), x[one] @ coarse)
                for m, (a, b) in enumerate(zip(books.cuts, books.cuts[1:], strict=False)):
                    score += (books.words[m] @ x[one, a:b])[codes[left, m]]
                # A cosine differs from its score by at most the length of what the code leaves out.
                near = score >= threshold - error[left] - 1e-5
                if i != j:
                    near &= side[left] != side[one]
                at = np.flatnonzero(near)
                near[at] = x[left[at]] @ x[one] >= threshold - 1e-9
                edges += [(int(ids[one]), int(ids[r])) for r in left[near]]
                queue += left[near].tolist()
                left = left[~near]
        return pa.Table.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=_EDGES)

    return run


_FOUND = pa.schema([("list", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("score", pa.float32()), ("ca", pa.int64()), ("cb", pa.int64()), ("more", pa.bool_())])
_FOUND_KIND = "list int, i int, j int, a bigint, b bigint, score float, ca bigint, cb bigint, more boolean"


def _scan(shared, threshold: float, best_only: bool):
    """A list's own vectors are queries; codes of vectors from other lists are looked up in their tables. Of the pairs that
    could reach the threshold between two components the best comes out, or all."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        books: Codebooks = shared.value
        valid = pa.compute.is_valid(rows.column("v"))
        own, guests = rows.filter(valid), rows.filter(pa.compute.invert(valid))
        parts: list[np.ndarray] = []
        if own.num_rows and guests.num_rows:
            ids, x, mine = own.column("node").to_numpy(), unit(matrix(own.column("v"))), own.column("component").to_numpy()
            other, codes, theirs = guests.column("node").to_numpy(), _codes(guests), guests.column("component").to_numpy()
            home, error = guests.column("home").to_numpy(), guests.column("error").to_numpy()
            for at in range(0, len(ids), CHUNK):
                one = slice(at, at + CHUNK)
                score = books.scores(x[one], home, codes)
                r, c = np.nonzero((score >= threshold - error - 1e-5) & (mine[one, None] != theirs))
                pair = np.empty(len(r), dtype=[("ca", "i8"), ("cb", "i8"), ("score", "f4"), ("a", "i8"), ("b", "i8"), ("more", "?")])
                a, b, ca, cb = ids[one][r], other[c], mine[one][r], theirs[c]
                pair["ca"], pair["cb"], pair["a"], pair["b"] = np.minimum(ca, cb), np.maximum(ca, cb), np.minimum(a, b), np.maximum(a, b)
                pair["score"], pair["more"] = score[r, c], False
                parts.append(_best(pair) if best_only else pair)
        found = np.concatenate(parts) if parts else np.zeros(0, dtype=[(n, "i8") for n in ("ca", "cb", "score", "a", "b", "more")])
        if best_only and len(parts) > 1:
            found = _best(found)
        keys = [pa.array(np.full(len(found), k.as_py(), dtype=np.int32)) for k in key]
        return pa.Table.from_arrays([*keys, *[pa.array(found[t.name]).cast(t.type) for t in list(_FOUND)[3:]]], schema=_FOUND)

    return run


def _best(pair: np.ndarray) -> np.ndarray:
    """The best pair of each two components, and whether there are more."""
    if not len(pair):
        return pair
    order = np.lexsort((pair["b"], pair["a"], -pair["score"], pair["cb"], pair["ca"]))
    pair = pair[order]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair["ca"][1:] != pair["ca"][:-1]) | (pair["cb"][1:] != pair["cb"][:-1])
    first = np.flatnonzero(new)
    more = np.add.reduceat(pair["more"].astype(int), first) + np.diff(first, append=len(pair)) > 1
    out = pair[first]
    out["more"] = more
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.einsum("ij,ij->i", unit(matrix(batch.column(2))), unit(matrix(batch.column(3)))) >= threshold - 1e-9
            yield batch.filter(pa.array(same)).select(["a", "b"])

    return run


def _exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact cosine reaches the threshold."""
    va = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"))
    vb = nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    joined = pairs.select("a", "b").join(va, "a").join(vb, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(_verify(threshold), "a bigint, b bigint")


def _components(edges: DataFrame) -> DataFrame:
    return materialise(connected_components(edges), "components")


def _still_apart(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` whose components ``known(node, component)`` doesn't join."""
    for end in ("ca", "cb"):
        side = known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_"))
        found = found.join(split_by_size(side), end, "left").withColumn(f"{end}_", F.coalesce(f"{end}_", end))
    return found.where("ca_ <> cb_").drop("ca_", "cb_")


def _edges_of(nodes: DataFrame, dim: int, count: int, threshold: float, probes: int, chunk: int) -> DataFrame:
    """(a, b) edges that span the near-duplicate groups of the vectors of one length."""
    spark = nodes.sparkSession
    own = nodes.where(F.col("dim") == dim).select("node", "v")
    books = fit_codebooks(own, count, max(1, math.ceil(math.sqrt(count))))
    shared = spark.sparkContext.broadcast(books)
    kind = dict(own.dtypes)["v"]
    coded = materialise(own.mapInArrow(_encode(shared, probes), f"node bigint, home int, codes binary, error float, probes array<int>, v {kind}"), "codes")
    # Within lists: chunk against chunk, by tasks of their own.
    sizes = materialise(coded.groupBy("home").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "sizes")
    cut = coded.join(split_by_size(sizes), "home").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = cut.select("home", "node", "codes", "error", "v", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    sure = materialise(tiles.groupBy("home", "i", "j").applyInArrow(_link(shared, threshold), "a bigint, b bigint"), "linked")
    known = _components(sure)
    # Across lists: vectors look up the codes of those that probe their list, but of their own component.
    named = coded.join(split_by_size(known), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    guests = named.select(F.explode("probes").alias("list"), "node", "codes", "home", "error", F.lit(None).cast(kind).alias("v"), "component").where("list <> home")
    room = guests.groupBy("list").agg(F.ceil(F.count("*") / (4 * chunk)).cast("int").alias("guest_chunks"))
    room = materialise(room.join(sizes.withColumnRenamed("home", "list"), "list"), "room")
    hosts = named.select(F.col("home").alias("list"), "node", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("int").alias("home"), F.lit(None).cast("float").alias("error"), "v", "component")

    def cross(side: DataFrame, mine: str, theirs: str, own: str, other: str) -> DataFrame:
        placed = side.join(split_by_size(room), "list").withColumn(own, F.pmod(F.xxhash64("node"), F.col(mine)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("chunks", "guest_chunks")

    met = cross(hosts, "chunks", "guest_chunks", "i", "j").unionByName(cross(guests, "guest_chunks", "chunks", "j", "i"))
    found = materialise(met.groupBy("list", "i", "j").applyInArrow(_scan(shared, threshold, True), _FOUND_KIND), "found")
    best = found.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p")).select("p.a", "p.b")
    sure = materialise(sure.union(_exact(best, coded, threshold)), "sure")
    # Where the best pair didn't hold, another one may: all pairs of the components that are still apart.
    rest = materialise(_still_apart(found, _components(sure)), "rest")
    if rest.isEmpty():
        return sure
    again = rest.where("more").select("list", "i", "j").distinct()
    every = met.join(split_by_size(again), ["list", "i", "j"], "left_semi").groupBy("list", "i", "j").applyInArrow(_scan(shared, threshold, False), _FOUND_KIND)
    open_ = every.join(split_by_size(rest.select("ca", "cb").distinct()), ["ca", "cb"], "left_semi").select("a", "b").union(rest.select("a", "b")).distinct()
    return materialise(sure.union(_exact(open_, coded, threshold)), "edges")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Groups of vectors linked by a cosine of at least ``threshold``: group_id (the least id), n_vectors, vec_ids (sorted).

    Equal vectors are one node. A coarse quantiser of the square root of the table's size in lists, and code words of
    residuals in 8 subspaces, are fitted by k-means over all vectors. Every vector is a query in its own list, and is
    looked for by its code in its ``probes`` nearest lists. Asymmetric distances come from table look-ups; a pair stays
    a candidate if its score plus the length of its code's error reaches the threshold, so within the lists probed none
    is lost. Candidates are verified by exact cosine: in a list at once, across lists the best pair of two components
    first and all others only if that fails. Recall of linked pairs against brute force is at least 0.9 (tested); it
    grows with ``probes``. A list of more than ``chunk`` members is cut, and its chunks are compared in full by tasks of
    their own.

    Of rows with one id the least vector counts; null ids and vectors that are null, empty or hold a null, NaN or
    infinite element are in no group, nor is a zero vector but with other zero vectors. Ids are whole numbers. Vectors of
    different lengths aren't compared. Groups have two ids or more; an empty table gives no rows; other columns aren't
    read.
    """
    own = clean_vectors(vectors, id_col, vector_col).withColumn("node", F.min("vec_id").over(_equal()))
    own = materialise(own, "vectors")
    nodes = own.where("node = vec_id").select("node", "dim", "v")
    edges = own.where("node <> vec_id").select(F.col("node").alias("a"), F.col("vec_id").alias("b"))
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        if r["n"] > 1:
            edges = edges.union(_edges_of(nodes, r["dim"], r["n"], threshold, probes, chunk))
    groups = connected_components(edges).groupBy("component")
    return groups.agg(F.count("*").alias("n_vectors"), F.array_sort(F.collect_list("node")).alias("vec_ids")).select(F.col("component").alias("group_id"), "n_vectors", "vec_ids")


def _equal():
    from pyspark.sql import Window

    return Window.partitionBy(F.xxhash64("v"), "v")
