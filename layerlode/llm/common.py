"""What the ten training-data operators share: the scratch folder, written tables and token hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be collected by the driver or broadcast; beyond it every operator has a distributed way.
DRIVER_ROWS = 1_000_000

#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Unset, a temporary folder serves, but only where the session runs in one process (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="layerlode-")
        _local_dirs[context.applicationId] = f"file://{path}"
        context.setCheckpointDir(f"file://{path}")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _local_dirs[context.applicationId]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: work done once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    if path.startswith("file://"):
        shutil.rmtree(path[len("file://") :], ignore_errors=True)


def bounded_sample(df: DataFrame, rows: int, hashed: Column, total: int) -> DataFrame:
    """The first ``rows`` of the ``total`` rows of ``df`` in the order of a 64-bit hash, for fitting a model.

    A share of the hash's range is filtered first, so that no more than little over ``rows`` leave their partitions
    however large the table is.
    """
    share = min(1.0, (rows + 10 * rows**0.5 + 50) / max(total, 1))
    own = df.withColumn("_hash", hashed)
    if share < 1:
        own = own.where(F.col("_hash") < int(-(1 << 63) + share * ((1 << 64) - 1)))
    return own.orderBy("_hash").limit(rows)


def small_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_ROWS`` rows at once to Python in this session, unless it was set: texts make rows large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Memory that this process freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for a task; when it ends, memory that it freed goes back to the system, for a Python worker lives on and
    serves tasks of other operators."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """64 bits that identify a row by id and text; equal for repeated rows, never null."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def split_by_size(side: DataFrame, limit: int = DRIVER_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``limit`` rows, else left to a shuffle join."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


# ---- hashing of word tokens, without a Python object per token -------------------------------------------------

_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True
_WORD[128:] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64 on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, _PIECE + 1)
        for key, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every maximal run of word bytes in ``raw``."""
    word = _WORD[raw]
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def token_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word token of a UTF-8 buffer of any length.

    A token is a maximal run of letters, digits, ``_`` and non-ASCII bytes. Work goes by pieces of about 1 MB that end
    where no word does, so memory doesn't follow the length of a text.
    """
    found, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and _WORD[raw[end]]:
            rest = np.flatnonzero(~_WORD[raw[end : end + _PIECE]])
            end = end + int(rest[0]) if len(rest) else min(end + _PIECE, len(raw))
        starts, hashes = _piece_hashes(raw[at:end])
        found.append((starts + at, hashes))
        at = end
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def utf8_column(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows that hold at most ``most`` bytes, or one row."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = max(first + 1, min(last, len(offsets) - 1))
        out.append((first, last))
        first = last
    return out


