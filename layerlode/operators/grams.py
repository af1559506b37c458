"""The most frequent word n-grams and their cells, counted as 64-bit hashes of runs of words: strings are built for the few
that are kept.

A gram is one of the ``most`` frequent only if its count reaches the least count of any ``most`` grams. Runs of a few
million grams are sorted where they are read; each sends the counts that are beyond its own threshold and the threshold,
which bounds what it keeps back. The sums bound every gram's count from both sides (Fagin et al., 2003; Cao and Wang,
2004): those that can be among the most frequent are few and are counted exactly in another pass. Two grams of one hash
count as one; at 5e9 different grams the chance that this touches one of 100,000 candidates is under 3e-5.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.memory import tidy
from layerlode.functions.text import STOP_WORDS
from layerlode.sources.store import written

#: Grams of a sorted run; tokens that are looked at together.
RUN, SLICE = 1 << 22, 1 << 18
#: A run sends at most so many counts for each gram that is asked for, in the first pass.
SENT = 2
#: Candidates that the driver takes and every task holds.
CANDIDATES = 2_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of grams with one more word."""
    return _mixed(grams * _STEP + words)


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, dtype=np.uint64)


class Slice:
    """Rows of words as numbers: what is found in them by place."""

    def __init__(self, tokens: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.end = np.cumsum(lengths)

    def grams(self, low: int, high: int, stop: Collection[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the grams of n words whose first and last word isn't in ``stop``."""
        hashes, stops = _word_hashes(self.words)[self.codes], np.isin(self.codes, np.flatnonzero(pc.is_in(self.words, pa.array([*stop], self.words.type)).to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(~stops)
        left = self.end[self.row[at]] - at
        found = hashes[at]
        for n in range(1, high + 1):
            if n > 1:
                some = left >= n
                at, left = at[some], left[some]
                found = _longer(found[some], hashes[at + (n - 1)])
            if n >= low:
                whole = ~stops[at + (n - 1)] if n > 1 else slice(None)
                yield n, at[whole], found[whole]

    def text(self, at: int, n: int) -> str:
        return " ".join(self.words.take(pa.array(self.codes[at : at + n])).to_pylist())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """Rows with at most ``SLICE`` words, or one row."""
    for batch in batches:
        tokens = batch.column("tokens")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, side="right")))
            part = batch.slice(first, last - first)
            yield part, Slice(part.column("tokens"))
            first = last


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, their counts) of an array that is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(first, append=len(keys))


class Lookup:
    """Positions in a sorted array of hashes, through a table of their highest bits."""

    def __init__(self, hashes: np.ndarray):
        bits = min(22, max(8, int(len(hashes)).bit_length() + 5))
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        first = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.first, self.many = first[:-1], np.diff(first).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``keys`` of those that are held, their positions among the hashes)."""
        high = (keys >> self.shift).astype(np.int64)
        at = np.flatnonzero(self.many[high])
        high = high[at]
        keys, near, far = keys[at], self.first[high], self.many[high]
        found = np.full(len(at), -1, dtype=np.int64)
        for k in range(int(far.max(initial=0))):
            some = np.flatnonzero(far > k)
            same = self.hashes[near[some] + k] == keys[some]
            found[some[same]] = near[some[same]] + k
        held = found >= 0
        return at[held], found[held]


def _bounded_counts(tokens: DataFrame, low: int, high: int, stop: Collection[str], sent: int | None, least: int | None, run: int) -> DataFrame:
    """(hash, n, t), written: sums of the counts that the runs of a few million grams send, and of these runs' thresholds.

    A run sends counts beyond its threshold t: the least for which no more than ``sent`` are sent, or ``least`` - 1. The
    row without a hash has the sum of all thresholds in n, the number of runs in t.
    """

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _runs_of(np.concatenate(held))
            if sent is None:
                t = least - 1
            else:
                t = int(np.partition(counts, len(counts) - sent - 1)[len(counts) - sent - 1]) if len(counts) > sent else 0
            some = counts > t
            hashes = pa.concat_arrays([pa.array(keys[some].view(np.int64)), pa.nulls(1, pa.int64())])
            n, ts = np.append(counts[some], t), np.append(np.full(int(some.sum()), t), 1)
            return pa.RecordBatch.from_arrays([hashes, pa.array(n.astype(np.int64)), pa.array(ts.astype(np.int64))], names=["hash", "n", "t"])

        for _, part in _slices(batches):
            for _, _, found in part.grams(low, high, stop):
                held.append(found)
                total += len(found)
            if total >= run:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    sent_rows = tokens.select("tokens").mapInArrow(tidy(tops), "hash bigint, n bigint, t bigint")
    return written(sent_rows.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "gram_bounds")


def top_grams(tokens: DataFrame, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS, most: int = 50_000, min_occurrences: int = 1, run: int = RUN, candidates: int = CANDIDATES) -> DataFrame | None:
    """(term, occurrences) of all n-grams of ``tokens(tokens)`` that can be among the ``most`` frequent, counted exactly:
    they are among these rows with all ties of the last one's count. Words hold no spaces.

    None where more than ``candidates`` can be, as where most grams occur as often as the last.
    """
    spark = tokens.sparkSession
    sent, least = SENT * most, None
    while True:
        sums = _bounded_counts(tokens, low, high, stop, sent, least, run)
        kept_back = sums.where("hash is null").first()
        unseen, runs = (kept_back["n"], kept_back["t"]) if kept_back else (0, 0)
        best = sums.where("hash is not null").select("n").orderBy(F.desc("n")).limit(most).agg(F.min("n").alias("n"), F.count("*").alias("many")).first()
        reached = max(min_occurrences, best["n"]) if best["many"] == most else max(min_occurrences, 1)
        if unseen < reached:
            break
        # Counts that no run sent add up to less than the count that is reached if each is under its share of it.
        least = max(1, -(-reached // runs)) if least is None else 1
        sent = None
    upper = F.col("n") - F.col("t") + unseen
    some = sums.where("hash is not null").where(upper >= reached).select("hash").limit(candidates + 1).toArrow().column("hash").to_numpy()
    if len(some) > candidates:
        return None
    held = spark.sparkContext.broadcast(np.sort(some.view(np.uint64)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value)
        counts = np.zeros(len(held.value), dtype=np.int64)
        names: dict[int, str] = {}
        for _, part in _slices(batches):
            for n, at, found in part.grams(low, high, stop):
                place, which = lookup.find(found)
                fresh = np.flatnonzero(counts[which] == 0)
                for k, first in zip(*np.unique(which[fresh], return_index=True), strict=True):
                    names[int(k)] = part.text(int(at[place[fresh[first]]]), n)
                counts += np.bincount(which, minlength=len(counts))
        if names:
            own = np.array(sorted(names))
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in own.tolist()], pa.string()), pa.array(counts[own])], names=["term", "occurrences"])

    found = tokens.select("tokens").mapInArrow(tidy(exact), "term string, occurrences bigint")
    return found.groupBy("term").agg(F.sum("occurrences").alias("occurrences")).where(F.col("occurrences") >= min_occurrences)


def _term_hashes(terms: list[str]) -> np.ndarray:
    pieces = [t.split(" ") for t in terms]
    many = np.array([len(p) for p in pieces], dtype=np.int64)
    words = _word_hashes(pa.array([w for p in pieces for w in p], pa.string()))
    first = np.cumsum(many) - many
    out = words[first] if len(terms) else np.zeros(0, dtype=np.uint64)
    for k in range(1, int(many.max(initial=1))):
        some = np.flatnonzero(many > k)
        out[some] = _longer(out[some], words[first[some] + k])
    return out


def gram_cells(tokens: DataFrame, terms: DataFrame, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS) -> DataFrame:
    """(object_id, term_ids, ns): which of ``terms(term, term_id)`` occur in a row of ``tokens(object_id, tokens)``, and how
    often; a row without any has no row. The vocabulary is held by every task. Nothing moves."""
    known = terms.select("term", "term_id").where("term is not null").toPandas()
    hashes = _term_hashes(known["term"].tolist())
    order = np.argsort(hashes)
    held = tokens.sparkSession.sparkContext.broadcast((hashes[order], known["term_id"].to_numpy()[order]))
    kinds = {f.name: f.dataType.simpleString() for f in [*tokens.schema.fields, *terms.schema.fields]}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, ids = Lookup(held.value[0]), held.value[1]
        for batch, part in _slices(batches):
            keys = [np.zeros(0, dtype=np.int64)]
            for _, at, found in part.grams(low, high, stop):
                place, which = lookup.find(found)
                keys.append(part.row[at[place]] * len(ids) + which)
            own, counts = _runs_of(np.concatenate(keys))
            if len(own):
                rows, which = np.divmod(own, len(ids))
                rows, many = _runs_of(rows)
                offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[which], counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("object_id").take(pa.array(rows)), *lists], names=["object_id", "term_ids", "ns"])

    return tokens.select("object_id", "tokens").mapInArrow(tidy(cells), f"object_id {kinds['object_id']}, term_ids array<{kinds['term_id']}>, ns array<bigint>")


def packed(counts: DataFrame) -> DataFrame:
    """(object_id, term_ids, ns): cells of ``counts(object_id, term_id, n)`` that follow each other and are of one object as
    one row. Nothing moves; an object may have several rows. Packed counts stay as they are."""
    if "term_ids" in counts.columns:
        return counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ends = pc.run_end_encode(batch.column("object_id"))
                offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.run_ends])
                lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("term_id", "n")]
                yield pa.RecordBatch.from_arrays([ends.values, *lists], names=["object_id", "term_ids", "ns"])

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    return counts.select("object_id", "term_id", "n").mapInArrow(run, f"object_id {kinds['object_id']}, term_ids array<{kinds['term_id']}>, ns array<{kinds['n']}>")


def unpacked(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., term_id, n): a row for each cell of packed counts."""
    own = cells.select(*keys, "ns", F.posexplode("term_ids").alias("_i", "term_id"))
    return own.select(*keys, "term_id", F.get("ns", F.col("_i")).alias("n"))
