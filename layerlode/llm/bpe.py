"""Byte-pair encoding with forced boundaries: bytes that are neighbours in no token are cut apart before merging."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.llm.common import runs, small_batches, tidy, utf8_column

#: Ranks of a public byte-level vocabulary; the split of texts into words that it was made with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE, _LONG, _NONE = 1 << 17, 64, 1 << 62
_ODD, _CUT = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")
_RUN = 1 << 20


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def allowed_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256: whether two bytes are neighbours inside any token. Where they aren't, no merge can cross."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        if len(token) > 1:
            own = np.frombuffer(token, dtype=np.uint8)
            inside[own[:-1], own[1:]] = True
    return inside


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of ``piece``: again and again the leftmost pair of least rank is merged."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= _LONG else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], _NONE)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap of pairs: O(n log n)."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 when it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class _Memory(dict):
    """What ``make`` gives for a key, remembered in two generations: when the younger is full it becomes the older, and
    what is asked for again moves back, so frequent keys stay. Keys beyond ``_LONG`` aren't kept."""

    def __init__(self, make: Callable, most: int = _CACHE):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _LONG:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes and decodes in one process. Words and fragments that came before are remembered, up to a bound."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.inside = allowed_pairs(self.ranks)
        self.stretches = _Memory(lambda text: self.stretch(" " + text))
        self.words = _Memory(self.word)
        self.fragments = _Memory(self.merged)
        self.rows = self.inside.tolist()
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        by_id = {rank: token for token, rank in self.ranks.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.lengths = np.array([len(x) for x in self.tokens])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def cuts(self, raw: bytes) -> list[int]:
        """Where a word is cut for certain: between bytes that are neighbours in no token."""
        if len(raw) <= _LONG:
            rows = self.rows
            return [i for i, (a, b) in enumerate(zip(raw, raw[1:], strict=False), 1) if not rows[a][b]]
        own = np.frombuffer(raw, dtype=np.uint8)
        return (np.flatnonzero(~self.inside[own[:-1], own[1:]]) + 1).tolist()

    def merged(self, piece: bytes) -> bytes:
        return np.array(merge(piece, self.ranks), dtype="<i4").tobytes()

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        if raw in self.packed:
            return self.packed[raw]
        cuts = self.cuts(raw)
        if not cuts:
            return self.merged(raw)
        return b"".join([self.fragments[raw[a:b]] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)])

    def stretch(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        return self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def encode_packed(self, text: str) -> bytes:
        """Tokens as 32-bit integers, end to end.

        A space before a character that isn't white space always begins a word of the pattern, so texts are first cut
        there and whole stretches between such spaces are remembered.
        """
        first, *rest = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        return self.stretch(first) + b"".join(map(self.stretches.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<i4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", errors="replace")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """One encoder for each process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


_ROWS = "doc_id bigint, token_ids array<int>, n_tokens int, n_bytes bigint, round_trip boolean"


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            raw, offsets = utf8_column(batch.column(1))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for first, last in runs(offsets, _RUN):
                parts = [own.encode_packed(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")) if offsets[i + 1] > offsets[i] else b"" for i in range(first, last)]
                counts = np.array([len(x) // 4 for x in parts], dtype=np.int64)
                flat = np.frombuffer(b"".join(parts), dtype="<i4")
                del parts
                whole = own.decode_bytes(flat)
                stops = np.concatenate([[0], np.cumsum(counts)])
                lengths = np.diff(np.concatenate([[0], np.cumsum(own.lengths[flat])])[stops])
                # If every text has the bytes that its tokens have and all bytes are the same, each text came back.
                if whole == raw[offsets[first] : offsets[last]].tobytes():
                    good = lengths == np.diff(offsets[first : last + 1])
                else:
                    at = np.concatenate([[0], np.cumsum(lengths)])
                    good = np.array([whole[at[i - first] : at[i - first + 1]] == raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)])
                lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat), mask=pa.array(null[first:last]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        lists,
                        pa.array(counts.astype(np.int32)),
                        pa.array(np.diff(offsets[first : last + 1])),
                        pa.array(good, mask=null[first:last]),
                    ],
                    names=["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"],
                )

    return run


def bpe_encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Encode every text and decode it again.

    A text is split into words by ``pattern``; a word is cut between bytes that are neighbours inside no token of the
    vocabulary, for no merge can cross there; the fragments are merged independently and their tokens concatenated.
    Special tokens' strings are ordinary text. The result equals that of merging whole words.

    One row for each row: doc_id, token_ids, n_tokens, n_bytes and round_trip (decoding gave the same bytes). A null
    text has null token_ids and round_trip and 0 tokens; an empty one has an empty list and true. Texts of any length
    are encoded whole; repeated rows and null ids are rows like others; an empty table gives no rows; other columns
    aren't read. ``path`` is read by every executor.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(narrow).mapInArrow(tidy(_encode(path, pattern)), _ROWS)


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = [None if x is None else own.decode([i for i in x if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return run


def bpe_decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id and text of every row of (doc_id, token_ids). Null lists give null texts, null ids add nothing, an id that
    the vocabulary lacks fails the query, bytes that aren't UTF-8 become U+FFFD."""
    narrow = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids"))
    return narrow.mapInArrow(_decode(path, pattern), "doc_id bigint, text string")
