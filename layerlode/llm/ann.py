"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, exact recomputation, merging by heaps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.llm.common import materialise
from layerlode.llm.vectors import clean_vectors, matrix, unit

NEIGHBOURS = 10
#: Bytes of a block of vectors at most; rows of a tile.
BLOCK_BYTES, _ROWS, _COLUMNS, _PAIRS = 32 << 20, 512, 4096, 1 << 17
#: Dimensions whose products of int8 codes add up exactly in float32: 127 * 127 * 1040 < 2^24.
_EXACT = 1040
#: Cosines are ranked by their value to so many digits, ties by the neighbour's id.
DIGITS = 6


class Quantised:
    """Unit vectors as int8 codes times a scale for each row, and the length of what that leaves out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, unit(x)
        most = np.abs(self.x).max(axis=1, initial=0.0)
        self.scale = np.where(most > 0, most / 127, 1.0)
        codes = np.rint(self.x / self.scale[:, None])
        self.error = np.sqrt(((self.x - codes * self.scale[:, None]) ** 2).sum(axis=1))
        self.codes = codes.astype(np.int8)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes, exact: matrices of whole numbers that float32 adds up without rounding, slab by slab."""
    if a.shape[1] <= _EXACT:
        return a.astype(np.float32) @ b.T.astype(np.float32)
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].T.astype(np.float32)
    return out


def _cosines(a: Quantised, b: Quantised, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i in range(0, len(rows), _PAIRS):
        at = slice(i, i + _PAIRS)
        out[at] = np.einsum("ij,ij->i", a.x[rows[at]], b.x[cols[at]])
    return np.round(out, DIGITS) + 0.0


def search(a: Quantised, b: Quantised, k: int, heaps: list[list[tuple[float, int]]]) -> None:
    """Add to the heap of every row of ``a`` its ``k`` nearest rows of ``b``, other ids only.

    The exact product of int8 codes times the scales differs from the cosine by at most ``e_b + e_a (1 + e_b)``; scaling
    in float32 rounds four times, under 5e-7 in all, which the slack of 1e-6 covers. A pair whose upper bound is under the row's k-th cosine so far, or under the k-th
    lower bound in its tile, can't be among the nearest; all others are recomputed in float64.
    """
    slack = 0.51 * 10.0**-DIGITS + 1e-6
    wide = 1 + float(b.error.max(initial=0.0))
    for i in range(0, len(a.ids), _ROWS):
        one = slice(i, i + _ROWS)
        extra = a.error[one] * wide + slack
        for j in range(0, len(b.ids), _COLUMNS):
            two = slice(j, j + _COLUMNS)
            upper = code_products(a.codes[one], b.codes[two]).astype(np.float32, copy=False)
            upper *= a.scale[one, None].astype(np.float32)
            upper *= b.scale[two].astype(np.float32)
            upper += b.error[two].astype(np.float32)
            least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[i : i + _ROWS]])
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and upper.shape[1] > k + 1:
                # One of the k + 1 best in the tile can be the row itself.
                lower = upper[fresh] - 2 * b.error[two].astype(np.float32)
                least[fresh] = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)] - extra[fresh]
            rows, cols = np.nonzero(upper >= (least - extra)[:, None].astype(np.float32))
            rows, cols = rows + i, cols + j
            other = a.ids[rows] != b.ids[cols]
            rows, cols = rows[other], cols[other]
            found = _cosines(a, b, rows, cols)
            for r, c, n in zip(rows.tolist(), found.tolist(), (-b.ids[cols]).tolist(), strict=True):
                heap = heaps[r]
                if len(heap) < k:
                    heapq.heappush(heap, (c, n))
                elif (c, n) > heap[0]:
                    heapq.heapreplace(heap, (c, n))


_PART = pa.schema([("vec_id", pa.int64()), ("cosines", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])


def _parts(ids: np.ndarray, heaps: list[list[tuple[float, int]]]) -> pa.Table:
    ranked = [sorted(h, reverse=True) for h in heaps]
    return pa.Table.from_arrays([pa.array(ids), pa.array([[c for c, _ in h] for h in ranked], pa.list_(pa.float64())), pa.array([[-n for _, n in h] for h in ranked], pa.list_(pa.int64()))], schema=_PART)


def _tile(k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block = rows.column("block").to_numpy()
        sides = []
        for side in (i, j):
            own = rows.filter(pa.array(block == side))
            sides.append(Quantised(own.column("vec_id").to_numpy(), matrix(own.column("v"))))
            if i == j:
                break
        a, b = sides[0], sides[-1]
        out = []
        for one, other in ((a, b),) if i == j else ((a, b), (b, a)):
            heaps: list[list[tuple[float, int]]] = [[] for _ in one.ids]
            search(one, other, k, heaps)
            out.append(_parts(one.ids, heaps))
        return pa.concat_tables(out)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            for own, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ways = [[(-c, n) for c, n in zip(p["cosines"], p["ids"], strict=True)] for p in parts]
                out += [(own, rank, n, -c) for rank, (c, n) in enumerate(islice(heapq.merge(*ways), k), 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["vec_id", "rank", "neighbour_id", "cosine"])

    return run


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` nearest other vectors of every vector by cosine: vec_id, rank (from 1), neighbour_id, cosine.

    The table is hashed into blocks; each pair of blocks is a task that searches both ways. Vectors are quantised to
    int8 with a known error; tiles of int8 products bound every cosine, pairs that could be among the nearest are
    recomputed in float64 and kept in a heap for each row; the heaps of all blocks are merged. The result is that of
    brute force: every row is a query, no pair is left out but by its bound.

    Cosines are rounded to 6 digits and ranked by that, ties by the lesser id. Of rows with one id the least vector
    counts; null ids and vectors that are null, empty or hold a null, NaN or infinite element are left out. A zero
    vector has cosine 0 with all. Vectors of different lengths aren't compared. With fewer than ``k`` others a row has
    fewer neighbours; an empty table gives no rows; other columns aren't read.

    A block is sent to as many tasks as there are blocks, which is the price of an exact join: blocks are as large as
    ``block_bytes`` allows while there is a task for each core.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    own = materialise(clean_vectors(vectors, id_col, vector_col), "vectors")
    sizes = {r["dim"]: r["n"] for r in own.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cores = spark.sparkContext.defaultParallelism
    spread = math.ceil(math.sqrt(2 * cores))
    blocks = {d: max(math.ceil(n * d * 17 / block_bytes), min(spread, math.ceil(n / 1024))) for d, n in sizes.items()}
    many = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("dim")] if blocks else F.lit(1)
    placed = own.withColumn("many", many).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("many")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    tiles = paired.groupBy("dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = tiles.applyInArrow(_tile(k), "vec_id bigint, cosines array<double>, ids array<bigint>")
    gathered = parts.groupBy("vec_id").agg(F.collect_list(F.struct("cosines", "ids")).alias("parts"))
    return gathered.mapInArrow(_merge(k), "vec_id bigint, rank int, neighbour_id bigint, cosine double")
