"""Layers of density clusters: core distances and spanning trees by blocks, then a linkage cut at growing sizes.

Published methods: Campello et al. (2013), McInnes and Healy (2017). Work over pairs of different points runs in tasks, a
pair of blocks each; the driver holds the n - 1 edges of one spanning tree, and a few neighbours of each point.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.sources.store import written

#: Rows of a block; edges that the driver takes.
BLOCK, DRIVER_EDGES = 2048, 20_000_000


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors at length 1, on which Euclidean distance ranks as cosine does; those without a length stay."""
    from layerlode.functions.vectors import norm

    own = vectors.select("object_id", "embedding").withColumn("_n", norm(F.col("embedding")))
    return own.select("object_id", F.when(F.col("_n") > 0, F.transform("embedding", lambda x: x / F.col("_n"))).otherwise(F.col("embedding")).alias("embedding"))


#: Neighbours of each point that the driver takes; rows and columns of the distances that a task holds at once; rows of a
#: block at most, where there are enough pairs of blocks for all cores.
NEAR, TILE, WIDE, LARGE = 12, 256, 1024, 65_536


def _blocks(n: int, block: int, cores: int) -> int:
    """As few blocks as give each core some pairs: every point is sent once for each."""
    return max(1, min(math.ceil(n / block), max(math.ceil(math.sqrt(8 * cores)), math.ceil(n / LARGE))))


def _block_pairs(points: DataFrame, many: int, key: str = "object_id") -> DataFrame:
    """Each row once for each block that its own meets: (i, j, side, ...) with i <= j."""
    own = points.withColumn("side", F.pmod(F.xxhash64(key), F.lit(many)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    return own.withColumn("i", F.least("side", "_o")).withColumn("j", F.greatest("side", "_o")).drop("_o")


@dataclass
class _Side:
    """Points in the order of their ids. ``left`` and ``right`` are their vectors with two more places, so that the product of
    one's left and another's right is the square of their distance."""

    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    more: dict[str, np.ndarray]

    @classmethod
    def of(cls, table: pa.Table, side: int, *names: str) -> _Side:
        own = table.filter(pc.equal(table.column("side"), side)).sort_by("id")
        vectors = own.column("embedding").combine_chunks()
        flat = (vectors if isinstance(vectors, pa.Array) else pa.concat_arrays(vectors.chunks)).flatten()
        x = flat.to_numpy(zero_copy_only=False).reshape(own.num_rows, -1) if own.num_rows else np.zeros((0, 0))
        squares, ones = (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))
        return cls(own.column("id").to_numpy(), np.hstack([-2 * x, squares, ones]), np.hstack([x, ones, squares]), {c: own.column(c).to_numpy() for c in names})

    def some(self, which: np.ndarray) -> _Side:
        return _Side(self.ids[which], self.left[which], self.right[which], {k: v[which] for k, v in self.more.items()})


def _keys(table: pa.Table) -> tuple[int, int]:
    return table.column("i")[0].as_py(), table.column("j")[0].as_py()


def _distinct(points: DataFrame) -> DataFrame:
    """(id, many, ids, embedding), written: different points, with the least id of each, the number and ids of its copies."""
    own = points.groupBy("embedding").agg(F.sort_array(F.collect_list("object_id")).alias("ids"))
    return written(own.select(F.get("ids", F.lit(0)).alias("id"), F.size("ids").alias("many"), "ids", "embedding"), "distinct_points")


def _neighbours(distinct: DataFrame, n: int, k: int, block: int) -> DataFrame:
    """(id, near), written: up to ``k`` nearest other points of each point, as (squared distance, id, number of copies)."""

    def run(table: pa.Table) -> pa.Table:
        i, j = _keys(table)
        out = []
        for a, b in dict.fromkeys([(i, j), (j, i)]):
            one, two = _Side.of(table, a), _Side.of(table, b, "many")
            for r in range(0, len(one.ids) if len(two.ids) else 0, TILE):
                own, hits, least = one.ids[r : r + TILE], [], None
                for c in range(0, len(two.ids), WIDE):
                    far = one.left[r : r + TILE] @ two.right[c : c + WIDE].T
                    if a == b:  # no point is its own neighbour
                        self_at = np.arange(max(r, c), min(r + len(far), c + far.shape[1]))
                        far[self_at - r, self_at - c] = np.inf
                    if least is None:
                        least = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.finfo(float).max)
                    at, col = np.nonzero(far <= least[:, None])
                    hits.append((at, col + c, far[at, col]))
                at, col, far = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.lexsort((col, far, at))
                at, col, far = at[order], col[order], far[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                out.append(pa.table({"id": own[at[kept]], "far": np.maximum(far[kept], 0), "other": two.ids[col[kept]], "many": two.more["many"][col[kept]]}))
        whole = pa.concat_tables(out) if out else None
        if whole is None or not whole.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("far", pa.float64()), ("other", pa.int64()), ("many", pa.int32())])))})
        ids = whole.column("id").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        items = pa.StructArray.from_arrays([whole.column(c).combine_chunks() for c in ("far", "other", "many")], names=["far", "other", "many"])
        return pa.table({"id": ids[first], "near": pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), items)})

    kind = "array<struct<far: double, other: bigint, many: int>>"
    many = _blocks(n, block, distinct.sparkSession.sparkContext.defaultParallelism)
    parts = _block_pairs(distinct.select("id", "many", "embedding"), many, "id").groupBy("i", "j").applyInArrow(run, f"id bigint, near {kind}")
    merged = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    # A single point has no neighbours.
    return written(distinct.select("id").join(merged, "id", "left").select("id", F.coalesce("near", F.array().cast(kind)).alias("near")), "neighbours")


def _with_core(distinct: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """``distinct`` with near and core_distance: copies are at no distance, a neighbour counts once for each of its copies."""
    own = distinct.join(near, "id")
    each = F.flatten(F.transform("near", lambda x: F.array_repeat(x["far"], F.least(x["many"], F.lit(k)))))
    at = F.least(F.lit(k) - (F.col("many") - 1), F.size(each)) - 1
    return own.withColumn("core_distance", F.when(F.col("many") > k, F.lit(0.0)).otherwise(F.coalesce(F.sqrt(F.get(each, at)), F.lit(0.0))))


def core_distances(points: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(object_id, core_distance): Euclidean distance to the ``k``-th nearest other point; to the farthest if there are fewer.

    Copies of a point are looked at once. Each pair of blocks gives every row its ``k`` nearest in the other block; the
    least ``k`` of all are merged.
    """
    own = _distinct(points)
    found = _with_core(own, _neighbours(own, own.count(), k, block), k)
    return found.select(F.explode("ids").alias("object_id"), "core_distance")


def _prim(ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the spanning tree under mutual reachability; ties in the order of ids."""
    n = len(ids)
    best, other = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    norms = (x * x).sum(axis=1)
    at = 0
    us, vs, ws = np.zeros(n - 1, dtype=np.int64), np.zeros(n - 1, dtype=np.int64), np.zeros(n - 1)
    for step in range(n - 1):
        left[at] = False
        far = np.sqrt(np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0))
        reach = np.maximum(np.maximum(far, core), core[at])
        nearer = left & (reach < best)
        best[nearer], other[nearer] = reach[nearer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        us[step], vs[step], ws[step] = ids[other[at]], ids[at], best[at]
    return np.minimum(us, vs), np.maximum(us, vs), ws


class _Forest:
    """Components of points 0 to n - 1, and the edges that tie them."""

    def __init__(self, n: int):
        self.of, self.edges = np.arange(n), []

    def add(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        """Edges in order of weight, then ends, where their ends aren't tied yet."""
        names, flat = np.unique(self.of[np.concatenate([u, v])], return_inverse=True)
        order = np.lexsort((v, u, w))
        a, b = flat[: len(u)].tolist(), flat[len(u) :].tolist()
        root = list(range(len(names)))
        kept = []
        for k in order.tolist():
            i, j = a[k], b[k]
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
                kept.append(k)
        self.edges.append((w[kept], u[kept], v[kept]))
        top = np.array(root, dtype=np.int64)
        while (top[top] != top).any():
            top = top[top]
        own = np.arange(len(self.of))
        own[names] = names[top]
        self.of = own[self.of]

    def least(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(components that edges leave, position of the least of these edges for each, least weight by component). Ties go
        by the ends, and each component takes one: two edges as light as its least may not both be in the tree."""
        least = np.full(len(self.of), np.inf)
        a, b = self.of[u], self.of[v]
        np.minimum.at(least, a, w)
        np.minimum.at(least, b, w)
        some = np.flatnonzero((w == least[a]) | (w == least[b]))
        order = some[np.lexsort((v[some], u[some]))]
        own, at = np.concatenate([a[order], b[order]]), np.concatenate([order, order])
        rank = np.tile(np.arange(len(order)), 2)
        good = w[at] == least[own]
        own, at, rank = own[good], at[good], rank[good]
        by = np.lexsort((rank, own))
        names, first = np.unique(own[by], return_index=True)
        return names, at[by[first]], least


def _tied_by_neighbours(forest: _Forest, w: np.ndarray, u: np.ndarray, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boruvka's rounds over known edges, as far as they are the least of a component: an edge that isn't known weighs
    ``bound`` of its ends at least. What is left of the edges leaves components."""
    while True:
        out = forest.of[u] != forest.of[v]
        w, u, v = w[out], u[out], v[out]
        own, at, least = forest.least(w, u, v)
        floor = np.full(len(bound), np.inf)
        np.minimum.at(floor, forest.of, bound)
        sure = np.unique(at[least[own] <= floor[own]])
        if not len(sure):
            return w, u, v
        forest.add(w[sure], u[sure], v[sure])


def _leaving(one: _Side, two: _Side, most: np.ndarray, both: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(component, squared weight, least id, other id) of edges from components of ``one``, and of ``two`` if ``both``, that
    weigh no more than the least known of their component. ``most`` has these by component and falls."""
    out = []
    core = [side.more["core"] ** 2 for side in (one, two)]
    for r in range(0, len(one.ids), TILE):
        for c in range(0, len(two.ids), WIDE):
            ours, theirs = one.more["of"][r : r + TILE], two.more["of"][c : c + WIDE]
            far = one.left[r : r + TILE] @ two.right[c : c + WIDE].T
            top = most[ours]
            new = np.flatnonzero(np.isinf(top))
            if len(new):  # nothing is known of their components: the nearest of each is
                part = np.maximum(np.maximum(far[new], core[0][r + new][:, None]), core[1][None, c : c + WIDE])
                part[ours[new][:, None] == theirs[None, :]] = np.inf
                np.minimum.at(most, ours[new], part.min(axis=1))
                top = most[ours]
                top[np.isinf(top)] = -1
            hit = far <= top[:, None]
            if both:
                hit |= far <= most[theirs][None, :]
            at, col = np.nonzero(hit)
            some = ours[at] != theirs[col]
            at, col = at[some], col[some]
            w = np.maximum(np.maximum(far[at, col], core[0][r + at]), core[1][c + col])
            a, b = one.ids[r + at], two.ids[c + col]
            low, high = np.minimum(a, b), np.maximum(a, b)
            for own in (ours[at], theirs[col]) if both else (ours[at],):
                good = w <= most[own]
                np.minimum.at(most, own[good], w[good])
                good = w <= most[own]
                out.append((own[good], w[good], low[good], high[good]))
    return out


def _least_leaving(distinct: DataFrame, n_blocks: int, ids: np.ndarray, of: np.ndarray, known: np.ndarray) -> pa.Table:
    """(own, w, u, v): the least edge that leaves each component but the largest; ``known`` bounds its squared weight."""
    names, flat, sizes = np.unique(of, return_inverse=True, return_counts=True)
    largest = int(np.argmax(sizes))
    most = known[names]
    most[largest] = -1
    held = distinct.sparkSession.sparkContext.broadcast((ids, flat.astype(np.int32), most))

    def run(table: pa.Table) -> pa.Table:
        every, flat, most = held.value
        most = most.copy()
        i, j = _keys(table)
        sides = [_Side.of(table, k, "core") for k in dict.fromkeys([i, j])]
        for side in sides:
            side.more["of"] = flat[np.searchsorted(every, side.ids)]

        small = [side.some(side.more["of"] != largest) for side in sides]
        found = _leaving(small[0], sides[-1], most, i != j)
        if i != j:
            found += _leaving(small[1], sides[0].some(sides[0].more["of"] == largest), most, False)
        own, w, u, v = (np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in range(4))
        order = np.lexsort((v, u, w, own))
        first = order[np.flatnonzero(np.diff(own[order], prepend=-1))]
        return pa.table({"own": own[first].astype(np.int64), "w": w[first].astype(np.float64), "u": u[first].astype(np.int64), "v": v[first].astype(np.int64)})

    rows = _block_pairs(distinct.select("id", "core", "embedding"), n_blocks, "id").groupBy("i", "j").applyInArrow(run, "own bigint, w double, u bigint, v bigint")
    return rows.groupBy("own").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("own", "e.*").toArrow()


def _boruvka(points: DataFrame, min_samples: int, block: int, driver_edges: int) -> pd.DataFrame:
    """Edges of the spanning tree by least edges of components (Boruvka, 1926): first among near neighbours, as far as these
    are sure to hold the least, then by passes over all pairs of blocks, in which only edges as light as those known count.

    A copy hangs on the point with its vector and the least id.
    """
    own = _distinct(points)
    n = own.count()
    if n > driver_edges:
        raise ValueError(f"{n} edges are more than the driver takes; raise driver_edges or cluster a sample")
    k = max(NEAR, min_samples)
    cored = _with_core(own, _neighbours(own, n, k, block), min_samples)
    cored = written(cored.select("id", "ids", "near", F.col("core_distance").alias("core"), "embedding"), "cored_points")
    table = cored.select("id", "core", "ids", F.transform("near", lambda x: x["far"]).alias("far"), F.transform("near", lambda x: x["other"]).alias("other")).toArrow().sort_by("id").combine_chunks()
    ids, core = table.column("id").to_numpy(), table.column("core").to_numpy()
    flat = {c: pc.list_flatten(table.column(c)).to_numpy() for c in ("far", "other", "ids")}
    many = pc.list_value_length(table.column("far")).to_numpy()
    u, v = np.repeat(np.arange(n), many), np.searchsorted(ids, flat["other"])
    bound = np.full(n, np.inf)
    full = np.flatnonzero(many >= k)
    bound[full] = np.maximum(flat["far"][np.cumsum(many)[full] - 1], core[full] ** 2)
    w = np.maximum(np.maximum(flat["far"], core[u] ** 2), core[v] ** 2)
    forest = _Forest(n)
    w, u, v = _tied_by_neighbours(forest, w, np.minimum(u, v), np.maximum(u, v), bound)
    n_blocks = _blocks(n, block, points.sparkSession.sparkContext.defaultParallelism)
    while len(np.unique(forest.of)) > 1:
        out = forest.of[u] != forest.of[v]
        w, u, v = w[out], u[out], v[out]
        own, at, least = forest.least(w, u, v)
        found = _least_leaving(cored, n_blocks, ids, forest.of, least)
        names, sizes = np.unique(forest.of, return_counts=True)
        fw, fu, fv = found.column("w").to_numpy(), np.searchsorted(ids, found.column("u").to_numpy()), np.searchsorted(ids, found.column("v").to_numpy())
        got = np.full(n, np.inf)
        got[names[found.column("own").to_numpy()]] = fw
        # An edge that is known counts where a pass found none as light: sums of products may end in other digits.
        still = np.unique(at[(least[own] < got[own]) & (own != names[np.argmax(sizes)])])
        if not len(fw) + len(still):
            raise ValueError("there are points without a distance to others")
        forest.add(np.concatenate([fw, w[still]]), np.concatenate([fu, u[still]]), np.concatenate([fv, v[still]]))
    w, u, v = (np.concatenate([e[k] for e in forest.edges]) if forest.edges else np.zeros(0, dtype=np.int64) for k in range(3))
    copies = pc.list_value_length(table.column("ids")).to_numpy()
    of = np.repeat(np.arange(n), copies)
    rest = flat["ids"] != ids[of]
    us, vs = np.concatenate([ids[u], ids[of[rest]]]), np.concatenate([ids[v], flat["ids"][rest]])
    return pd.DataFrame({"u": us, "v": vs, "w": np.concatenate([np.sqrt(w), core[of[rest]]])}).sort_values(["w", "u", "v"], ignore_index=True)


_EDGES = "u bigint, v bigint, w double"


def spanning_tree(points: DataFrame, min_samples: int = 5, block: int = BLOCK, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(u, v, w) of the minimum spanning tree under mutual reachability, in order of weight.

    Up to ``block`` points are one task's; more go in rounds over pairs of blocks, see ``_boruvka``.
    """
    spark = points.sparkSession
    if points.limit(block + 1).count() > block:
        return spark.createDataFrame(pa.Table.from_pandas(_boruvka(points, min_samples, block, driver_edges), preserve_index=False), _EDGES)
    own = points.join(core_distances(points, min_samples, block), "object_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("object_id")
        if len(rows) < 2:
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "w": pd.Series(dtype="float64")})
        u, v, w = _prim(rows["object_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()), rows["core_distance"].to_numpy())
        return pd.DataFrame({"u": u, "v": v, "w": w})

    edges = own.groupBy().applyInPandas(run, _EDGES).toPandas()
    return spark.createDataFrame(edges.sort_values(["w", "u", "v"]), _EDGES)


@dataclass
class Linkage:
    """Single linkage of a spanning tree. Nodes under n are objects, n + k is the k-th merge.

    ``low`` and ``high`` bound the smallest sizes at which a node is a leaf of the condensed tree: it must come out of a
    split into two sides of that size (``high``), and not split so itself (``low``).
    """

    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, u: np.ndarray, v: np.ndarray, w: np.ndarray, ids: np.ndarray) -> Linkage:
        n = len(ids)
        order = np.lexsort((v, u, w))
        a, b = np.searchsorted(ids, u[order]).tolist(), np.searchsorted(ids, v[order]).tolist()
        root, top = list(range(n)), list(range(n))
        total = 2 * n - 1
        left, right = np.full(total, -1), np.full(total, -1)
        size, low, high = np.ones(total, dtype=np.int64), np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
        for k, (i, j) in enumerate(zip(a, b, strict=True)):
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            x, y, at = top[i], top[j], n + k
            left[at], right[at], size[at] = min(x, y), max(x, y), size[x] + size[y]
            split = min(size[x], size[y])
            high[x] = high[y] = split
            low[at] = max(low[x], low[y], split)
            root[max(i, j)] = min(i, j)
            top[min(i, j)] = at
        return cls(ids, left, right, size, low, high)

    def leaves(self, least: int) -> np.ndarray:
        """Nodes that are leaf clusters when clusters have ``least`` objects or more."""
        return np.flatnonzero((self.low < least) & (least <= self.high))

    def labels(self, least: int) -> np.ndarray:
        """A label for each object, -1 outside of leaf clusters; labels in the order of their first object."""
        n = len(self.ids)
        held = np.full(len(self.size), -1)
        held[self.leaves(least)] = self.leaves(least)
        for at in range(len(self.size) - 1, n - 1, -1):
            if held[at] >= 0:
                held[self.left[at]] = held[self.right[at]] = held[at]
        own = held[:n]
        names, first = np.unique(own[own >= 0], return_index=True)
        rank = np.full(len(self.size) + 1, -1)
        rank[names[np.argsort(first)]] = np.arange(len(names))
        return np.where(own >= 0, rank[own], -1)

    def persistence(self) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, total persistence of the leaves at each): a leaf counts the range of sizes that it lives through."""
        alive = np.flatnonzero(self.high > np.maximum(self.low, 1))
        sizes = np.unique(self.high[alive])
        sizes = sizes[sizes > 1]
        spans = np.log(self.high[alive]) - np.log(np.maximum(self.low[alive], 1))
        total = np.array([spans[(self.low[alive] < m) & (m <= self.high[alive])].sum() for m in sizes])
        return sizes, total


METRICS = ("cosine", "euclidean")


def _linkage(vectors: DataFrame, min_samples: int, block: int, metric: str = "cosine") -> Linkage:
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}; there are {', '.join(METRICS)}")
    points = written(unit_vectors(vectors) if metric == "cosine" else vectors.select("object_id", "embedding"), "points")
    ids = np.sort(points.select("object_id").toArrow().column("object_id").to_numpy())
    tree = spanning_tree(points, min_samples, block).toArrow()
    return Linkage.of(*(tree.column(c).to_numpy() for c in ("u", "v", "w")), ids)


def size_for_count(count: Callable[[int], tuple[int, int]], target: int, n: int) -> int:
    """The smallest cluster size whose number of clusters is nearest to ``target``, by bisection over 2 to n / 2.

    ``count(size)`` gives clusters and clustered objects; of two sizes as near the one with more objects is taken.
    """
    low, high = 2, max(2, n // 2)
    while high - low > 1:
        middle = (low + high) // 2
        if count(middle)[0] > target:
            low = middle
        elif count(middle)[0] < target:
            high = middle
        else:
            low = high = middle
    (a, na), (b, nb) = count(low), count(high)
    if abs(a - target) != abs(b - target):
        return low if abs(a - target) < abs(b - target) else high
    return low if na > nb else high


def layer_sizes(linkage: Linkage, min_clusters: int, base_min_cluster_size: int | None, base_n_clusters: int | None, quantile: float, max_layers: int | None) -> list[int]:
    """The smallest cluster size of each layer, fine to coarse; ``ValueError`` if the first has too few clusters."""

    def sizes_at(least: int) -> np.ndarray:
        return linkage.size[linkage.leaves(least)]

    if base_n_clusters is not None:
        size = size_for_count(lambda m: (len(sizes_at(m)), int(sizes_at(m).sum())), base_n_clusters, len(linkage.ids))
        held = sizes_at(size)
        size = max(size, int(held.min())) if len(held) else size
    elif base_min_cluster_size is not None:
        size = base_min_cluster_size
    else:
        raise ValueError("give base_min_cluster_size or base_n_clusters")
    held = sizes_at(size)
    if len(held) < min_clusters:
        raise ValueError(f"{len(held)} clusters of at least {size} objects are fewer than {min_clusters}")
    out: list[int] = []
    while len(held) >= max(min_clusters, 1) and (max_layers is None or len(out) < max_layers):
        out.append(size)
        following = int(np.quantile(held, quantile))
        if following <= size + 1:
            break
        size, held = following, sizes_at(following)
    return out


def _frame(vectors: DataFrame, linkage: Linkage, sizes: list[int]) -> DataFrame:
    parts = [pa.table({"object_id": linkage.ids, "layer": np.full(len(linkage.ids), k, dtype=np.int32), "cluster": linkage.labels(m).astype(np.int32)}) for k, m in enumerate(sizes)]
    return vectors.sparkSession.createDataFrame(pa.concat_tables(parts), "object_id bigint, layer int, cluster int")


def density_layers(
    vectors: DataFrame,
    min_clusters: int = 6,
    min_samples: int = 5,
    base_min_cluster_size: int | None = 10,
    base_n_clusters: int | None = None,
    quantile: float = 0.85,
    max_layers: int | None = None,
    block: int = BLOCK,
    metric: str = "cosine",
) -> DataFrame:
    """(object_id, layer, cluster): leaf clusters at growing smallest sizes, each the quantile of the sizes before it.

    ``metric``: cosine for embeddings, euclidean for a map of few dimensions.
    """
    linkage = _linkage(vectors, min_samples, block, metric)
    return _frame(vectors, linkage, layer_sizes(linkage, min_clusters, base_min_cluster_size, base_n_clusters, quantile, max_layers))


def persistent_layers(vectors: DataFrame, min_clusters: int = 6, min_samples: int = 5, base_min_cluster_size: int = 10, max_layers: int = 10, block: int = BLOCK, metric: str = "cosine") -> DataFrame:
    """(object_id, layer, cluster, persistence): layers at the peaks of total leaf persistence, fine to coarse.

    Layers with fewer than ``min_clusters`` clusters go; the ``max_layers`` most persistent stay.
    """
    linkage = _linkage(vectors, min_samples, block, metric)
    sizes, total = linkage.persistence()
    keep = sizes >= base_min_cluster_size
    sizes, total = sizes[keep], total[keep]
    padded = np.concatenate([[-np.inf], total, [-np.inf]])
    peaks = [i for i in range(len(sizes)) if padded[i] < padded[i + 1] >= padded[i + 2] and len(linkage.leaves(int(sizes[i]))) >= min_clusters]
    if not peaks:
        raise ValueError(f"no layer has {min_clusters} clusters")
    best = sorted(sorted(peaks, key=lambda i: -total[i])[:max_layers])
    layers = _frame(vectors, linkage, [int(sizes[i]) for i in best])
    scores = vectors.sparkSession.createDataFrame([(k, float(total[i])) for k, i in enumerate(best)], "layer int, persistence double")
    return layers.join(F.broadcast(scores), "layer").select("object_id", "layer", "cluster", F.round("persistence", 6).alias("persistence"))
