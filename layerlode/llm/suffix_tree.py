"""Language-model scoring with a probabilistic suffix tree over bytes (Ron, Singer and Tishby, 1996)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.llm.common import give_back, materialise, mix64, runs, small_batches, tidy

#: Contexts of up to so many bytes are all counted; longer ones where a shorter one is open. Weight of the parent's
#: distribution in smoothing, in observations. Lengths in a row that may fail the test before growth along them ends.
BASE, SMOOTHING, LOOKAHEAD = 5, 4.0, 0
#: Hash tables of at most so many bytes are broadcast; larger ones in parts, a pass over the texts for each.
TABLE_BYTES = 128 << 20
#: The symbol before a text is a byte that UTF-8 has no use for.
_START = 0xFF
_PAD = b"\xff" * 8
_TAILS = 1 << 16  # pairs of symbols
_FILTER_BITS = 22
#: Contexts of up to so many symbols are named by them, packed in 64 bits with the next one; longer ones by a hash.
_PACKED = 7
_RUN, _ROWS, _COLLECTED = 1 << 20, 1 << 16, 1 << 18
#: Bytes of the runs that are scored; a scorer remembers 2 to so many bytes with their base contexts.
_SCORED, _KNOWN_BITS, _LONGER = 1 << 18, 20, np.uint64(1 << 63)
#: Bytes of a split that a task should have; slices of the keys that it adds up one after the other.
_SPLIT, _SLICES = 64 << 20, 8
#: Bytes of a slot, and slots for an entry at most.
_SLOT = 16 * 3
#: Lengths counted in one pass where the open contexts hold at most such a share of all bytes.
_STEPS = ((0.002, 16), (0.02, 4), (1.0, 2))
#: Counted rows of packed names, and four times those of hashed ones, that a task adds up before they leave it.
LOCAL_ROWS = 1 << 22
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Positions:
    """The bytes of some texts, each text behind 8 bytes ``_START``, with names for the contexts before them.

    A context of up to 7 symbols is named by its symbols, packed, with a 1 bit above them; a longer one by a 64-bit hash of
    its symbols and length. ``grams``: each byte, lowest, with the 7 symbols before it.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        self.starts = starts
        self._words = np.ndarray((len(raw) - 7,), ">u8", buffer=raw, strides=(1,))
        self.grams = self._words.astype(np.uint64)
        self.bytes = raw[7:]
        self._first: np.ndarray | None = None

    def texts(self) -> np.ndarray:
        return np.flatnonzero(self.bytes != _START)

    def room(self, at: np.ndarray, d: int) -> np.ndarray:
        """Whether positions ``at`` are bytes of texts with ``d`` symbols before them, one of them being that before their text."""
        if self._first is None:
            self._first = np.repeat((self.starts[:-1] + 1).astype(np.int32), np.diff(self.starts))[7:]
        return (self.bytes[at] != _START) & (at - self._first[at] + 1 >= d)

    def names(self, d: int, at: np.ndarray) -> np.ndarray:
        """Of the contexts of length ``d``; beyond 7 there must be room for them."""
        if d <= _PACKED:
            return packed(self.grams[at], d)
        name = np.full(len(at), d, dtype=np.uint64)
        for k in range(0, d, 8):
            word = self._words[at - (k + 1)].astype(np.uint64)
            if d - k < 8:
                word &= np.uint64((1 << 8 * (d - k)) - 1)
            name = mix64(name * _K[0] ^ word)
        return np.where(name == 0, np.uint64(1), name).view(np.int64)


def packed(grams: np.ndarray, d: int) -> np.ndarray:
    bit = np.uint64(1 << 8 * d)
    return ((grams >> np.uint64(8) & (bit - np.uint64(1))) | bit).view(np.int64)


def _cut(column: pa.Array, most: int = _RUN) -> Iterator[tuple[Positions, int, int]]:
    """Positions of runs of texts of about ``most`` bytes, with the rows that they cover."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    joined = pc.binary_join_element_wise(pa.scalar(_PAD, pa.large_binary()), column, pa.scalar(b"", pa.large_binary()))
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    for first, last in runs(offsets, most):
        yield Positions(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]), first, last


class _Sums:
    """Counted rows that are added up by key, a slice of the keys at a time."""

    def __init__(self, most: int | None = None):
        self.most, self.edges, self.held, self.rows, self.base = most, None, [], 0, 0

    def add(self, key: np.ndarray, n: np.ndarray, *columns: np.ndarray) -> bool:
        """Take rows with different keys in rising order; whether there are more than ``most`` now."""
        if not len(key):
            return False
        if self.edges is None:
            self.edges = key[np.arange(1, _SLICES) * len(key) // _SLICES]
            self.held = [[] for _ in range(_SLICES)]
        at = [0, *np.searchsorted(key, self.edges).tolist(), len(key)]
        for held, i, j in zip(self.held, at, at[1:], strict=False):
            if j > i:
                held.append(tuple(c[i:j] for c in (key, n, *columns)))
        self.rows += len(key)
        if self.rows <= 2 * self.base + (1 << 20 if self.most is None else min(self.most, 1 << 20)):
            return False
        self._unite()
        return self.most is not None and self.rows > self.most

    def _unite(self) -> None:
        self.rows = 0
        for i, held in enumerate(self.held):
            if len(held) > 1:
                key, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                one = order[first]
                self.held[i] = [(key[first], np.add.reduceat(n[order], first), *(np.concatenate([h[k] for h in held])[one] for k in range(2, len(held[0]))))]
            self.rows += len(self.held[i][0][0]) if held else 0
        self.base = self.rows

    def take(self) -> list[np.ndarray] | None:
        """Keys, in rising order, sums and other columns of all rows, which are held no longer."""
        self._unite()
        out = [np.concatenate(c) for c in zip(*(h[0] for h in self.held if h), strict=True)] or None
        self.edges, self.held, self.rows, self.base = None, [], 0, 0
        return out


def _packed_rows(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes, the first by differences, byte after byte and compressed."""
    columns = [np.diff(columns[0].view(np.uint64), prepend=np.uint64(0)), *columns[1:]]
    planes = np.concatenate([c.view(np.uint8).reshape(-1, 8).T.reshape(-1) for c in columns])
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked_rows(rows: bytes, many: int) -> list[np.ndarray]:
    n = int.from_bytes(rows[:8], "little")
    planes = np.frombuffer(pa.decompress(rows[8:], decompressed_size=n * 8 * many, codec="zstd", asbytes=True), dtype=np.uint8).reshape(many, 8, n)
    columns = [np.ascontiguousarray(c.T).reshape(-1).view(np.int64) for c in planes]
    return [np.cumsum(columns[0].view(np.uint64), dtype=np.uint64).view(np.int64), *columns[1:]]


_SENT = "task int, kind int, rows binary"
_COUNTS, _ABOVE = 0, 1


def _sent(kind: int, root: np.ndarray, columns: list[np.ndarray], tasks: int) -> pa.RecordBatch:
    """Rows for the tasks that their open contexts ``root`` go to, one package for each, in the order of the first column."""
    task = ((root.view(np.uint64) * _K[0] >> np.uint64(33)) % np.uint64(tasks)).astype(np.int32)
    order = np.argsort(columns[0].view(np.uint64))
    order = order[np.argsort(task[order].astype(np.uint16) if tasks <= 1 << 16 else task[order], kind="stable")]
    columns = [c[order] for c in columns]
    to, first = np.unique(task[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    packages = [_packed_rows([c[i:j] for c in columns]) for i, j in zip(first.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), kind, dtype=np.int32)), pa.array(packages, pa.binary())], names=["task", "kind", "rows"])


def _counted(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of ``depth`` symbols and the next one, and how many there are of each."""
    grams = grams & np.uint64((1 << 8 * (depth + 1)) - 1)
    grams.sort()
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    return grams[at], np.diff(at, append=len(grams))


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(LOCAL_ROWS)

        def out() -> Iterator[pa.RecordBatch]:
            key, n = sums.take() or (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            for i in range(0, len(n), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + _ROWS].view(np.int64)), pa.array(n[i : i + _ROWS])], names=["gram", "n"])

        for batch in batches:
            for own, *_ in _cut(batch.column(0)):
                grams, n = _counted(own.grams, depth)
                held = grams & np.uint64(255) != _START
                if sums.add(grams[held], n[held]):
                    yield from out()
        yield from out()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """Texts to count. Small splits are gathered, two tasks a core at least: what a task adds up needn't move."""
    spark = docs.sparkSession
    out = spread(docs.select(F.col("text").cast("string").alias("text")).where("length(text) > 0"))
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    many, cores = out.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return out.coalesce(max(2 * cores, -(-many * split // _SPLIT))) if many > 2 * cores and split < _SPLIT else out


def _bytes(setting: str) -> int:
    """A size as Spark's settings have it, such as 16m or 134217728b."""
    number = setting.strip().lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    return int(number[:-1] if scale else number) << scale


def gram_counts(docs: DataFrame, depth: int = BASE) -> DataFrame:
    """(gram, n): how often each byte follows each context of ``depth`` symbols, over whole texts of all rows."""
    # Tasks have added up their own rows: they are sent as they are, and added up where they arrive.
    return _texts(docs).mapInArrow(tidy(_count(depth)), "gram bigint, n bigint").repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"))


def distributions(grams: DataFrame, depth: int = BASE) -> DataFrame:
    """(d, ctx, parent, tail, n) for every context of 0 to ``depth`` symbols. ctx has a 1 bit above its symbols; tail is
    the next symbol, lowest, with those before it."""
    own = grams.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "gram", "n")
    own = own.selectExpr("d", "gram & (shiftleft(1L, 8 * (d + 1)) - 1) as tail", "n").groupBy("d", "tail").agg(F.sum("n").alias("n"))
    parent = "case when d > 0 then (shiftright(tail, 8) & (shiftleft(1L, 8 * (d - 1)) - 1)) | shiftleft(1L, 8 * (d - 1)) end"
    return own.selectExpr("d", "shiftright(tail, 8) | shiftleft(1L, 8 * d) as ctx", f"{parent} as parent", "tail", "n")


_SYM = "cast(tail & 255 as int)"
_PAIR = f"cast(shiftright(tail, 8) & {_TAILS - 1} as int)"


def tested(rows: DataFrame, above: DataFrame, half_log: float) -> DataFrame:
    """(ctx, d, parent, tail, total, fails, varied) of the contexts in ``rows(d, ctx, parent, tail, n)``; ``above(ctx, sym, n,
    total, fails)`` has the distributions of their longest suffixes.

    A context passes if its count times the Kullback-Leibler divergence (nats) from its suffix reaches ``half_log``
    times its successors, the Bayesian information criterion; ``fails`` is 0 then, else one more than its suffix's. It is
    varied if its count times its entropy reaches ``half_log``: for no longer context can the same product, nor count
    times divergence, be larger.
    """
    up = above.selectExpr("ctx as parent", "sym", "n as pn", "total as ptotal", "fails as before")
    sums = rows.selectExpr("d", "ctx", "parent", "tail", f"{_SYM} as sym", "n").join(up, ["parent", "sym"]).groupBy("ctx")
    sums = sums.agg(
        F.first("d").alias("d"), F.first("parent").alias("parent"), F.max("tail").alias("tail"), F.first("ptotal").alias("ptotal"), F.first("before").alias("before"),
        F.sum(F.expr("n * ln(n / pn)")).alias("a"), F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.expr("n * ln(n)")).alias("nl"),
    )
    return sums.selectExpr("ctx", "d", "parent", "tail", "total", f"if(a + total * ln(ptotal / total) >= {half_log!r}D * k, 0, before + 1) as fails", f"total * ln(total) - nl >= {half_log!r}D as varied")


class Table:
    """A hash table of int64 keys other than 0 in two arrays, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        size = 1 << max(4, (len(keys) + len(keys) // 2).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.int64)
        self.values = None if values is None else np.zeros(size, dtype=values.dtype)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == 0
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]] = keys[put]
            if values is not None:
                self.values[slots[put]] = values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, slots = keys[rest], (slots[rest] + 1) & int(self.mask)
            values = None if values is None else values[rest]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(29)) & self.mask).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where there is none."""
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, slots, -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at = (slots[open_] + 1) & int(self.mask)
            slots[open_] = at
            held = self.keys[at]
            same = held == keys[open_]
            out[open_[same]] = at[same]
            open_ = open_[~same & (held != 0)]
        return out


def parts_of(sizes: np.ndarray, limit: float) -> np.ndarray:
    """A part for each of the tails (two symbols), so that parts of ``sizes`` have about ``limit`` at most; -1 where none is."""
    out = np.full(len(sizes), -1, dtype=np.int32)
    part, held = 0, 0.0
    for tail in np.flatnonzero(sizes):
        if held and held + sizes[tail] > limit:
            part, held = part + 1, 0.0
        out[tail] = part
        held += sizes[tail]
    return out


def _tail_sizes(rows: DataFrame) -> np.ndarray:
    """How many ``rows`` each pair of symbols at the end of a context has; at most 2^18 pairs."""
    sizes = np.zeros(_TAILS)
    for r in rows.groupBy(F.expr(_PAIR).alias("t")).count().collect():
        sizes[r["t"]] = r["count"]
    return sizes


def _of_part(rows: DataFrame, parts: np.ndarray, part: int) -> DataFrame:
    return rows.where(F.expr(_PAIR).isin(np.flatnonzero(parts == part).tolist()))


def _slots(grams: np.ndarray, base: int) -> np.ndarray:
    """Where the last ``base`` symbols of a context are in the filter."""
    return ((grams << np.uint64(56 - 8 * base) >> np.uint64(64 - 8 * base)) * _K[0] >> np.uint64(64 - _FILTER_BITS)).view(np.int64)


class Open:
    """Names of contexts, behind a filter on the symbols at their end that spares most positions the look-up."""

    def __init__(self, ctx: np.ndarray, tail: np.ndarray, base: int):
        self.names = Table(ctx)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[_slots(tail.view(np.uint64), base)] = True


def _pairs(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(8) & np.uint64(_TAILS - 1)).view(np.int64)


def _extend(shared, base: int, d: int, steps: int, part: int | None, parts: np.ndarray | None, tasks: int, local_rows: int):
    """Counts of the contexts of lengths from ``d`` on, ``steps`` of them, whose suffix of length ``d - 1`` is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(local_rows if d <= _PACKED else local_rows // 4)
        low = np.uint64((1 << 8 * (base + 1)) - 1)

        def out() -> Iterator[pa.RecordBatch]:
            own = sums.take()
            if own is not None and d <= _PACKED:
                yield _sent(_COUNTS, packed(own[0], d - 1), own[:2], tasks)
            elif own is not None:
                _, n, ctx, parent, tail, root = own
                yield _sent(_COUNTS, root, [ctx, parent, tail, n], tasks)

        for batch in batches:
            for own, *_ in _cut(batch.column(0)):
                at = np.flatnonzero(shared.value.filter[_slots(own.grams, base)])
                if part is not None:
                    at = at[parts[_pairs(own.grams[at])] == part]
                at = at[own.room(at, d)]
                root = own.names(d - 1, at)
                held = np.flatnonzero(shared.value.names.find(root) >= 0)
                at, root = at[held], root[held]
                if d <= _PACKED:
                    if sums.add(*_counted(own.grams[at], d + steps - 1)):
                        yield from out()
                    continue
                for level in range(d, d + steps):
                    parent = root
                    if level > d:
                        room = own.room(at, level)
                        at, root = at[room], root[room]
                        parent = own.names(level - 1, at)
                    if not len(at):
                        break
                    # One more symbol before the suffix, and the next one, tell the rows of a level apart.
                    key = parent.view(np.uint64) * _K[0] + (own.bytes[at - level].astype(np.uint64) << np.uint64(8) | own.bytes[at]) * _K[1] + np.uint64(level)
                    order = np.argsort(key)
                    key = key[order]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    one = order[first]
                    tail = (own.grams[at[one]] & low | np.uint64(level - d << 56)).view(np.int64)
                    if sums.add(key[first], np.diff(first, append=len(key)), own.names(level, at[one]), parent[one], tail, root[one]):
                        yield from out()
        yield from out()

    return run


def _send_above(tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy() for c in batch.columns]
                yield _sent(_ABOVE, columns[0], columns, tasks)

    return run


_LEVELS = "d int, ctx bigint, parent bigint, tail bigint, n bigint, total bigint, fails int, varied boolean, first boolean"


def _lengths(grams: np.ndarray, n: np.ndarray, base: int, d: int, steps: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ctx, parent, tail, n) for each length from ``d`` on: the longest grams say what the shorter ones count."""
    for level in range(d, d + steps):
        own = grams & np.uint64((1 << 8 * (level + 1)) - 1)
        order = np.argsort(own)
        own = own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        each, own = np.add.reduceat(n[order], first), own[first]
        yield packed(own, level), packed(own, level - 1), (own & np.uint64((1 << 8 * (base + 1)) - 1)).view(np.int64), each


def _split(n: np.ndarray, ctx: np.ndarray, parent: np.ndarray, tail: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ctx, parent, tail, n) of each length, which the highest byte of ``tail`` says."""
    level, tail = tail >> 56, tail & ((1 << 56) - 1)
    for k in range(steps):
        at = np.flatnonzero(level == k)
        yield ctx[at], parent[at], tail[at], n[at]


def _test_levels(base: int, d: int, steps: int, half: float, lookahead: int):
    """Add up what ``_extend`` counted and test it as ``tested`` does, length after length: rows of the contexts that
    passed, or failed after at most ``lookahead`` lengths in a row. All rows of an open context are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, above = _Sums(), []
        for batch in batches:
            for kind, rows in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = _unpacked_rows(rows.as_py(), 2 if kind == _COUNTS and d <= _PACKED else 4)
                if kind == _ABOVE:
                    above.append(own)
                elif d <= _PACKED:
                    sums.add(own[0].view(np.uint64), own[1])
                else:
                    ctx, parent, tail, n = own
                    key = _entry_keys(ctx, tail & 255).view(np.uint64)
                    order = np.argsort(key)
                    sums.add(key[order], n[order], ctx[order], parent[order], tail[order])
        counts = sums.take()
        if counts is None or not above:
            return
        if d <= _PACKED:
            levels = _lengths(counts[0], counts[1], base, d, steps)
        else:
            levels = _split(*counts[1:], steps)
        ctx, sym, n, total = (np.concatenate(c) for c in zip(*above, strict=True))
        before = (ctx, sym & 255, n, total, (sym >> 8).astype(np.int32))
        for length, (ctx, parent, tail, n) in enumerate(levels, d):
            table = Table(_entry_keys(before[0], before[1]), np.arange(len(before[0])))
            slot = table.find(_entry_keys(parent, tail & 255))
            at = np.flatnonzero(slot >= 0)
            at = at[np.argsort(ctx[at], kind="stable")]
            if not len(at):
                return
            up = table.values[slot[at]]
            ctx, parent, tail, n = ctx[at], parent[at], tail[at], n[at]
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            each, k = n.astype(float), np.diff(first, append=len(at))
            total = np.add.reduceat(n, first)
            gain = np.add.reduceat(each * np.log(each / before[2][up]), first) + total * np.log(before[3][up[first]] / total)
            failed = np.where(gain >= half * k, 0, before[4][up[first]] + 1).astype(np.int32)
            varied = total * np.log(total) - np.add.reduceat(each * np.log(each), first) >= half
            lead = np.zeros(len(at), dtype=bool)
            lead[first] = True
            own = np.flatnonzero(np.repeat(failed <= lookahead, k))
            total, failed, varied = np.repeat(total, k)[own], np.repeat(failed, k)[own], np.repeat(varied, k)[own]
            columns = [np.full(len(own), length, dtype=np.int32), ctx[own], parent[own], tail[own], n[own], total, failed, varied, lead[own]]
            for i in range(0, len(own), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + _ROWS]) for c in columns], names=["d", "ctx", "parent", "tail", "n", "total", "fails", "varied", "first"])
            own = own[varied]
            before = (ctx[own], tail[own] & 255, n[own], total[varied], failed[varied])

    return run


def _longer(texts: DataFrame, above: DataFrame, open_: DataFrame, many_open: int, base: int, d: int, steps: int, half: float, table_bytes: int, lookahead: int, local_rows: int) -> DataFrame:
    """Tested rows, with what ``_LEVELS`` names, of the contexts of ``steps`` lengths from ``d`` on with a suffix in
    ``open_(ctx, tail)``; ``above(ctx, sym, n, total, fails)`` has the distributions of those."""
    spark = texts.sparkSession
    parts = parts_of(_tail_sizes(open_), table_bytes / _SLOT) if many_open * _SLOT > table_bytes else np.zeros(1, dtype=np.int32)
    many = int(parts.max(initial=-1)) + 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * texts.rdd.getNumPartitions())
    sent = above.selectExpr("ctx", "cast(sym + 256 * fails as bigint) as sym", "n", "total").mapInArrow(_send_above(tasks), _SENT)
    for part in range(many):
        own = (open_ if many == 1 else _of_part(open_, parts, part)).select("ctx", "tail").toArrow()
        shared = spark.sparkContext.broadcast(Open(own.column(0).to_numpy().astype(np.int64), own.column(1).to_numpy().astype(np.int64), base))
        counted = _extend(shared, base, d, steps, part if many > 1 else None, parts if many > 1 else None, tasks, local_rows)
        sent = sent.union(texts.mapInArrow(tidy(counted), _SENT))
    return sent.repartitionById(tasks, F.col("task")).mapInArrow(tidy(_test_levels(base, d, steps, half, lookahead)), _LEVELS)


def _shorter(own: DataFrame) -> DataFrame:
    """(d, ctx): packed contexts ``own(d, ctx)`` with all their suffixes."""
    every = own.select("ctx", F.explode(F.expr("sequence(0, d)")).alias("d"))
    return every.selectExpr("d", "(ctx & (shiftleft(1L, 8 * d) - 1)) | shiftleft(1L, 8 * d) as ctx").distinct()


def grown(docs: DataFrame, depth: int | None = None, lookahead: int = LOOKAHEAD, table_bytes: int = TABLE_BYTES, local_rows: int = LOCAL_ROWS) -> tuple[int, DataFrame]:
    """(base, (d, ctx, parent, tail, n, total)): the distributions of all states of the tree, of every length."""
    base = BASE if depth is None else min(BASE, depth)
    dist = materialise(distributions(gram_counts(docs, base), base), "distributions")
    total = dist.where("d = 0").agg(F.sum("n")).first()[0] or 0
    half = 0.5 * float(np.log(max(total, 1)))
    sums = dist.groupBy("ctx").agg(F.sum("n").alias("total"))
    above = dist.where(f"d < {base}").join(sums, "ctx").selectExpr("ctx", f"{_SYM} as sym", "n", "total", "0 as fails")
    low = materialise(tested(dist.where("d > 0"), above, half), "tested")  # fails: whether a context itself does
    ends = low.where("fails = 0").select("d", "ctx").union(dist.where("d = 0").select("d", "ctx").distinct())
    # Runs of failing lengths: of a context at the base and of its suffixes.
    last = low.where(f"d = {base} and varied").selectExpr("ctx", "tail", "total", "parent as up", "fails", "fails = 0 as done")
    for _ in range(lookahead if base > 1 else 0):
        suffix = low.selectExpr("ctx as up", "parent as next", "fails as more")
        last = last.join(suffix, "up", "left").selectExpr("ctx", "tail", "total", "next as up", "if(done, fails, fails + coalesce(more, 0)) as fails", "done or coalesce(more, 0) = 0 as done")
    levels: list[tuple[int, DataFrame]] = []
    texts = _texts(docs)
    open_ = last.where(f"fails <= {lookahead}").select("ctx", "tail", "total", "fails")
    open_ = materialise(open_, "open") if lookahead else open_
    above, d = dist.where(f"d = {base}").join(open_.select("ctx", "total", "fails"), "ctx"), base
    while base and (depth is None or d < depth):
        many_open, held = open_.agg(F.count("*"), F.sum("total")).first()
        if not many_open:
            break
        d += 1
        steps = _PACKED - d + 1 if d <= _PACKED else next(n for share, n in _STEPS if held <= share * total or share == 1)
        steps = steps if depth is None else min(steps, depth - d + 1)
        own = above.selectExpr("ctx", f"{_SYM} as sym", "n", "total", "fails")
        found = materialise(_longer(texts, own, open_, many_open, base, d, steps, half, table_bytes, lookahead, local_rows), "levels")
        levels += [(length, found) for length in range(d, d + steps)]
        d += steps - 1
        above = found.where(f"d = {d} and varied")
        open_ = above.where("first").select("ctx", "tail", "total", "fails")
    entry = ["d", "ctx", "parent", "tail", "n", "total"]
    entries = None
    if lookahead:
        # Suffixes of states are states: from the longest down.
        parents = None
        for length, found in reversed(levels):
            rows = found.where(f"d = {length}")
            own = rows.where("fails = 0 and first").select("ctx", "parent")
            if parents is not None:
                own = materialise(own.union(rows.where("first").select("ctx", "parent").join(parents, "ctx", "left_semi")).distinct(), "states")
            part = rows.join(own.select("ctx"), "ctx", "left_semi").select(entry)
            entries = part if entries is None else entries.unionByName(part)
            parents = own.select(F.col("parent").alias("ctx")).distinct()
        if parents is not None:
            ends = ends.union(parents.select(F.lit(base).alias("d"), "ctx"))
    else:
        # Only states were extended, and every found row is one's.
        for length, found in levels:
            if not any(found is f for k, f in levels if k < length):
                entries = found.select(entry) if entries is None else entries.unionByName(found.select(entry))
    part = dist.join(_shorter(ends), ["d", "ctx"], "left_semi").join(sums, "ctx").select(entry)
    return base, materialise(part if entries is None else entries.unionByName(part), "entries")


def _entry_keys(ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    keys = mix64(ctx.view(np.uint64) * _K[0] + sym.astype(np.uint64) * _K[1])
    return np.where(keys == 0, np.uint64(1), keys).view(np.int64)


class Scorer:
    """Smoothed log2 probabilities of a tree, for scoring the texts that it was counted on in one process: a context with
    a next symbol that it has seen has an entry if it is a state."""

    def __init__(self, levels: Iterator[tuple[np.ndarray, ...]], base: int, smoothing: float):
        """``levels``: contexts, suffixes, next symbols, their counts and all counts of the contexts, from length 0 on."""
        self.base, self.deepest, self.known = base, -1, None
        keys, logs, longer, before = [], [], [], None
        for ctx, parent, sym, n, total in levels:
            own = _entry_keys(ctx, sym)
            # Suffixes of states are states and have seen all that their extensions have, so every key is there.
            if before is not None:
                longer.append(_entry_keys(parent, sym))
            above = 1 / 256 if before is None else before.values[before.find(longer[-1])]
            prob = (n + smoothing * above) / (total + smoothing)
            keys.append(own)
            logs.append(np.log2(prob))
            before = Table(own, prob)
            self.deepest += 1
        del before
        self.entries = Table(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), np.concatenate(logs) if logs else np.zeros(0))
        # Entries that a longer one extends: beyond others no search is needed.
        self.more = np.zeros(len(self.entries.keys), dtype=bool)
        for own in longer:
            for i in range(0, len(own), _COLLECTED):
                self.more[self.entries.find(own[i : i + _COLLECTED])] = True

    def _in_base(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of different bytes with their base contexts: log2 of the probability in the longest state of up to ``base``
        symbols, and whether a longer one may have seen the byte."""
        # Suffixes of states are states, so a length that is none ends the search.
        sym, found = grams & np.uint64(255), np.full(len(grams), -1, dtype=np.int64)
        start = min(3, self.deepest, self.base)
        todo, below = np.arange(len(grams)), np.zeros(0, dtype=np.int64)
        for d in range(start, min(self.deepest, self.base) + 1):
            at = self.entries.find(_entry_keys(packed(grams[todo], d), sym[todo]))
            hit = at >= 0
            if d == start:
                below = todo[~hit]
            found[todo[hit]] = at[hit]
            todo = todo[hit][self.more[at[hit]]]
        for d in range(start - 1, -1, -1):
            found[below] = self.entries.find(_entry_keys(packed(grams[below], d), sym[below]))
            below = below[found[below] < 0]
        longer = np.zeros(len(grams), dtype=bool)
        longer[todo] = self.deepest > self.base
        return np.where(found >= 0, self.entries.values[found], -8.0), longer

    def log2(self, own: Positions, which: np.ndarray) -> np.ndarray:
        """log2 of the probability of each byte at ``which`` in the longest state that its context ends with."""
        if self.deepest < 0 or not len(which):
            return np.full(len(which), -8.0)
        if self.known is None:
            # Made where texts are scored, so it isn't sent. Pairs of 8 bytes, moved as one number: a gram, above it whether it
            # needs a longer search, and the bits of its log2. Gram 0 has slot 0: another gram there says that it is empty.
            self.known = np.zeros(1 << _KNOWN_BITS, dtype=np.complex128)
            self.known.view(np.uint64)[0] = 1
        grams = own.grams[which]
        grams &= np.uint64((1 << 8 * (self.base + 1)) - 1)
        slots = (grams * _K[0] >> np.uint64(64 - _KNOWN_BITS)).view(np.int64)
        pairs = self.known[slots]
        new = np.flatnonzero(pairs.view(np.uint64)[::2] & ~_LONGER != grams)
        if len(new):
            each, one, group = np.unique(grams[new], return_index=True, return_inverse=True)
            log, longer = self._in_base(each)
            found = np.stack([np.where(longer, each | _LONGER, each), log.view(np.uint64)], axis=1).view(np.complex128)[:, 0]
            pairs[new] = found[group]
            self.known[slots[new[one]]] = found
        out, more = pairs.view(np.float64)[1::2].copy(), pairs.view(np.uint64)[::2] >= _LONGER
        todo = np.flatnonzero(more)
        at = which[todo]
        for d in range(self.base + 1, self.deepest + 1):
            if not len(todo):
                break
            if d > _PACKED:
                room = own.room(at, d)
                todo, at = todo[room], at[room]
            slots = self.entries.find(_entry_keys(own.names(d, at), own.bytes[at]))
            hit = np.flatnonzero(slots >= 0)
            slots, todo = slots[hit], todo[hit]
            out[todo] = self.entries.values[slots]
            more = self.more[slots]
            todo, at = todo[more], at[hit[more]]
        return out


def _score(shared, base: int, part: int | None, parts: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for own, first, last in _cut(batch.column(1), _SCORED):
                which = own.texts()
                if part is not None:
                    which = which[np.maximum(parts[_pairs(own.grams[which])], 0) == part]
                ends = np.searchsorted(which, own.starts - 7)
                held = np.flatnonzero(np.diff(ends))
                if len(held):
                    # Each text by itself: equal texts have equal sums, whatever comes before them.
                    sums[first + held] = np.add.reduceat(shared.value.log2(own, which), ends[held])
                sizes[first:last] = np.diff(own.starts) - len(_PAD)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sums)], names=["id", "n_bytes", "log2_prob"])

    return run


def _scorer(entries: DataFrame, base: int, smoothing: float) -> Scorer:
    """The driver takes some rows at a time, so that it holds little besides the table itself."""
    sizes = {r["d"]: r["count"] for r in entries.groupBy("d").count().collect()}

    def levels() -> Iterator[tuple[np.ndarray, ...]]:
        for d in range(len(sizes)):
            many, parts = -(-sizes[d] // _COLLECTED), []
            for k in range(many):
                own = entries.where(f"d = {d}" + (f" and pmod(ctx, {many}) = {k}" if many > 1 else ""))
                rows = own.selectExpr("ctx", "coalesce(parent, 0L) as parent", f"cast({_SYM} as smallint) as sym", "n", "total").toArrow()
                parts.append([c.to_numpy() for c in rows.columns])
                del rows
                give_back()
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    return Scorer(levels(), base, smoothing)


def suffix_tree_scores(docs: DataFrame, depth: int | None = None, smoothing: float = SMOOTHING, table_bytes: int = TABLE_BYTES, lookahead: int = LOOKAHEAD, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Score every document with the suffix tree of the whole table.

    Counts of every byte after every context of up to 5 bytes are gathered over whole texts of all rows. Longer contexts
    are counted a byte at a time where the suffix of a context is open: where its next bytes vary enough that longer
    ones could still pass the test, and no more than ``lookahead`` lengths in a row have failed it (0: a context is
    extended while it passes). The tree grows until no context is open, whatever length that is; ``depth`` bounds it only where one is given (at least 0). ``tested``
    says which contexts become states; so do the suffixes of one that does. A state's next-byte distribution is
    smoothed with that of its longest suffix, ``(n + smoothing * above) / (total + smoothing)``, the root's with 1/256.
    A text's score is the sum over its bytes of log2 of their probability in the longest state that the bytes before
    end with. Contexts over 7 bytes are known by a 64-bit hash.

    One row for each row: doc_id (of the type it has), n_bytes, log2_prob, bits_per_byte. Null and empty texts have 0
    bytes, score 0 and a null bits_per_byte. Repeated rows are counted and scored as often as they occur; doc_id may be
    null. An empty table gives no rows; other columns aren't read. Open contexts and the tree are broadcast if their
    hash tables take at most ``table_bytes``. Else they are cut by the last two bytes of a context into parts of about
    that size, with a pass over the texts for each; the results are equal but for the order of a sum. So they are for any
    ``local_rows``, the counted rows that a task adds up before they leave it.
    """
    if depth is not None and depth < 0:
        raise ValueError("depth must be at least 0")
    spark = docs.sparkSession
    small_batches(spark)
    base, entries = grown(docs, depth, lookahead, table_bytes, local_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    parts = parts_of(_tail_sizes(entries.where("d > 1")), table_bytes / _SLOT) if base > 1 and entries.count() * _SLOT > table_bytes else np.full(_TAILS, -1)
    many = max(1, int(parts.max(initial=-1)) + 1)
    if many == 1:
        shared = spark.sparkContext.broadcast(_scorer(entries, base, smoothing))
        scored = spread(narrow).mapInArrow(tidy(_score(shared, base, None, None)), f"id {kind}, n_bytes bigint, log2_prob double")
    else:
        numbered = materialise(narrow.withColumn("row", F.monotonically_increasing_id()), "numbered")
        each = None
        for part in range(many):
            own = entries.where("d < 2").unionByName(_of_part(entries.where("d > 1"), parts, part))
            shared = spark.sparkContext.broadcast(_scorer(own, base, smoothing))
            found = numbered.select("row", "text").mapInArrow(tidy(_score(shared, base, part, parts)), "row bigint, n_bytes bigint, log2_prob double")
            each = found if each is None else each.union(found)
        sums = each.groupBy("row").agg(F.max("n_bytes").alias("n_bytes"), F.sum("log2_prob").alias("log2_prob"))
        scored = numbered.select("row", "id").join(sums, "row")
    return scored.select(F.col("id").alias("doc_id"), "n_bytes", "log2_prob", F.expr("-log2_prob / nullif(n_bytes, 0)").alias("bits_per_byte"))
