"""MinHash near-duplicate search with b-bit signatures (Li and König, 2010)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.llm.common import DRIVER_ROWS, mix64, materialise, row_key, runs, small_batches, split_by_size, tidy, token_hashes, utf8_column
from layerlode.llm.components import connected_components

SHINGLE, PERMUTATIONS, BAND_ROWS, BITS, THRESHOLD = 3, 128, 4, 4, 0.5
#: Buckets with more members are compared chunk against chunk, by tasks of their own.
CHUNK = 2048
_RUN = 1 << 20

_seeds = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_STEPS = np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_XOR = _seeds[:PERMUTATIONS].astype(np.uint32)
_MUL = _seeds[PERMUTATIONS:].astype(np.uint32) | np.uint32(1)


def _fmix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash of every shingle, its row) for the texts of a buffer.

    A shingle is ``SHINGLE`` word tokens in a row; a text with fewer has one, of all that it has; a text without words
    has one, of its bytes; an empty text has none.
    """
    starts, tokens = token_hashes(raw)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    padded = np.concatenate([tokens, np.zeros(SHINGLE - 1, dtype=np.uint64)])
    n = len(tokens)
    whole = np.zeros(n, dtype=np.uint64)
    firsts = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if n else np.zeros(0, dtype=np.int64)
    left = firsts + counts[rows] - np.arange(n)  # tokens of the same text from here on
    for k in range(SHINGLE):
        part = mix64(padded[k : k + n] + _STEPS[k])
        whole += np.where(left > k, part, np.uint64(0))
    keep = (left >= SHINGLE) | ((np.arange(n) == firsts) & (counts[rows] < SHINGLE))
    hashes, rows = (mix64(whole[keep]) >> np.uint64(32)).astype(np.uint32), rows[keep]
    bare = np.flatnonzero((counts == 0) & (np.diff(offsets) > 0))
    if len(bare):
        import xxhash

        own = [xxhash.xxh32_intdigest(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in bare]
        hashes, rows = np.concatenate([hashes, np.array(own, dtype=np.uint32)]), np.concatenate([rows, bare])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def minima(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their minima under every permutation). Work goes by runs of about 1 MB of text."""
    found_rows, found = [], []
    for first, last in runs(offsets, _RUN):
        base = offsets[first]
        hashes, rows = shingle_hashes(raw[base : offsets[last]], offsets[first : last + 1] - base)
        if not len(hashes):
            continue
        at = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.empty((PERMUTATIONS, len(at)), dtype=np.uint32)
        for k in range(PERMUTATIONS):
            np.minimum.reduceat((hashes ^ _XOR[k]) * _MUL[k], at, out=least[k])
        found_rows.append(rows[at] + first)
        found.append(least.T)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros((0, PERMUTATIONS), dtype=np.uint32)
    return np.concatenate(found_rows), np.concatenate(found)


def pack(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` of every minimum, packed: ``PERMUTATIONS * BITS / 8`` bytes a row."""
    low = (_fmix32(least) & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :]
    return np.packbits(bits.reshape(len(low), -1), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ``BAND_ROWS`` whole minima; equal keys make candidates."""
    bands = PERMUTATIONS // BAND_ROWS
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(least), axis=0)
    parts = least.reshape(len(least), bands, BAND_ROWS).astype(np.uint64)
    for r in range(BAND_ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal low bits, corrected for chance collisions."""
    chance = 2.0**-BITS
    return np.clip((equal / PERMUTATIONS - chance) / (1 - chance), 0, 1)


def equal_minima(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many packed minima agree: groups of ``BITS`` bits without a difference, by bit counts on 64-bit words."""
    differ = np.bitwise_xor(many, one)
    for step in (1, 2):  # folds the four bits of each minimum onto its lowest
        differ = differ | (differ >> np.uint64(step))
    ones = np.uint64(0x1111111111111111)
    return PERMUTATIONS - np.bitwise_count(differ & ones).sum(axis=-1, dtype=np.int64)


_SIGS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("packed", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_column(batch.column(2), lower=True)
        rows, least = minima(raw, offsets)
        if not len(rows):
            continue
        node = np.zeros(len(rows), dtype=np.uint64)
        for k in range(PERMUTATIONS):
            node = mix64(node * np.uint64(0x9E3779B97F4A7C15) + least[:, k].astype(np.uint64) + np.uint64(1))
        packed, bands = pack(least), band_keys(least)
        width = bands.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows)),
                batch.column(1).take(pa.array(rows)),
                pa.array(node.view(np.int64)),
                pa.array([x.tobytes() for x in packed], type=pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(bands.ravel())),
            ],
            schema=_SIGS,
        )


def signatures(docs: DataFrame) -> DataFrame:
    """(key, doc_id, node, packed, bands) for every row with a text that isn't empty; equal nodes have equal minima."""
    small_batches(docs.sparkSession)
    narrow = docs.select(row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(narrow.where("length(text) > 0")).mapInArrow(tidy(_sign), "key bigint, doc_id bigint, node bigint, packed binary, bands array<bigint>")


def link(nodes: np.ndarray, words: np.ndarray, threshold: float, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a bucket whose estimated similarity reaches the threshold.

    Breadth-first: each member reached is compared with all members not yet reached, so no pair that could join two
    components is left out. With ``split`` only pairs of a member before it and one from it on count.
    """
    least = np.ceil((threshold * (1 - 2.0**-BITS) + 2.0**-BITS) * PERMUTATIONS - 1e-9)
    edges, side = [], np.arange(len(nodes)) < (len(nodes) if split is None else split)
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = equal_minima(words[one], words[left]) >= least
            if split is not None:
                near &= side[left] != side[one]
            hit = left[near]
            edges += [(int(nodes[one]), int(nodes[x])) for x in hit]
            queue += hit.tolist()
            left = left[~near]
    return edges


def _link_buckets(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: set[tuple[int, int]] = set()
            listed, split = batch.column(0), batch.column(1).to_pylist()
            starts = np.asarray(listed.offsets)
            members = listed.values
            nodes = np.asarray(members.field("node"))
            held = members.field("packed")
            offs = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]
            words = np.frombuffer(held.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]].reshape(len(held), -1).view(np.uint64)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]  # most buckets are pairs: all at once
            near = estimate(equal_minima(words[two], words[two + 1])) >= threshold - 1e-9
            edges.update(zip(nodes[two[near]].tolist(), nodes[two[near] + 1].tolist(), strict=True))
            for i in np.flatnonzero(sizes > 2):
                own = slice(int(starts[i]), int(starts[i + 1]))
                if split[i] is None:
                    edges.update(link(nodes[own], words[own], threshold))
                else:
                    order = np.argsort(~np.isin(nodes[own], split[i]), kind="stable")
                    edges.update(link(nodes[own][order], words[own][order], threshold, len(split[i])))
            if edges:
                a, b = np.array(sorted(edges), dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def similar_nodes(sigs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between nodes: for each band bucket, a spanning forest of the pairs that reach the threshold.

    A bucket of any size is compared in full. One with more than ``chunk`` members is cut into chunks by a hash of
    the node before it is gathered, and each pair of chunks becomes a bucket of its own, which may run anywhere.
    Signatures move only to bands that two nodes or more share.
    """
    nodes = sigs.groupBy("node").agg(F.first("packed").alias("packed"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    sizes = nodes.select(F.explode("bands").alias("band")).groupBy("band").count().where("count > 1")
    shared = materialise(sizes.select("band", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "shared")
    if shared.limit(DRIVER_ROWS + 1).count() <= DRIVER_ROWS:
        banded = nodes.select(F.explode("bands").alias("band"), "node", "packed").join(F.broadcast(shared), "band")
    else:  # signatures follow only the nodes that share a band
        pairs = nodes.select(F.explode("bands").alias("band"), "node").join(shared, "band")
        banded = pairs.join(nodes.select("node", "packed"), "node").select("band", "node", "packed", "chunks")
    member = F.struct("node", "packed")
    cut = banded.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.groupBy("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    firsts = F.array_compact(F.collect_list(F.when(F.col("own") < F.col("other"), F.col("node"))))
    buckets = cut.agg(F.collect_list(member).alias("ms"), firsts.alias("split"))
    buckets = buckets.where("size(ms) > 1").select("ms", F.when(F.col("i") < F.col("j"), F.col("split")).alias("split"))
    return buckets.mapInArrow(tidy(_link_buckets(threshold)), "a bigint, b bigint")


def membership(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(key, doc_id, component) of every row that has a near duplicate or a copy; written, so it is computed once."""
    sigs = materialise(signatures(docs), "signatures")
    joined = connected_components(similar_nodes(sigs, threshold, chunk))
    rows = sigs.select("key", "doc_id", "node")
    found = rows.join(split_by_size(joined), "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("component"))
    sizes = materialise(found.groupBy("component").count().where("count > 1").select("component"), "sizes")
    return materialise(found.join(split_by_size(sizes), "component", "left_semi"), "membership")


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Groups of documents linked by an estimated Jaccard similarity of word 3-shingles of at least ``threshold``.

    One row for each group of two rows or more: ``group_id`` (its least doc_id, which is the one that stays),
    ``n_docs`` (rows, repeated ones counted) and ``doc_ids`` (sorted, each id once, null ids left out). Every row is a
    query; no text, bucket or group is cut short. Near duplicates are linked transitively.

    Null and empty texts are in no group. A text without words counts by its bytes. Repeated rows and exact copies are
    duplicates. An empty table gives no rows; columns other than doc_id and text aren't read. Pairs at exactly the
    threshold can go either way, for the estimate has a standard error of about 0.05.
    """
    groups = membership(docs, threshold, chunk).groupBy("component")
    return groups.agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids")).drop("component")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each near-duplicate group stays: that of the least doc_id.

    Null doc_ids come last; ties go to the least row key. Of repeated rows one stays. Null and empty texts all stay.
    Texts don't move between executors where the keys to drop can be broadcast (size checked), else by one join.
    """
    from pyspark.sql import Window

    own = membership(docs, threshold, chunk)
    order = Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "key")
    ranked = own.groupBy("component", "key", "doc_id").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order))
    decided = materialise(ranked.select("key", "r", "n"), "decided")
    names = docs.columns
    key = "_key" + "_" * max(len(x) for x in names)
    keyed = docs.withColumn(key, row_key())
    gone = decided.where("r > 1").select(F.col("key").alias(key))
    again = decided.where("r = 1 and n > 1").select(F.col("key").alias(key))
    kept = keyed.join(split_by_size(gone), key, "left_anti")
    if again.limit(1).count() == 0:
        return kept.drop(key)
    single = kept.join(split_by_size(again), key, "left_anti")
    twice = kept.join(split_by_size(again), key, "left_semi").dropDuplicates([key])
    return single.unionByName(twice).drop(key)
