"""Sequential choices among the few candidates of one cluster, in numpy: diversification and submodular greedy."""

from __future__ import annotations

import heapq

import numpy as np


def distances_to(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine distances; 1 where a vector has no length."""
    lengths = np.sqrt((others * others).sum(axis=1) * (vector @ vector))
    return np.where(lengths > 0, 1 - (others @ vector) / np.where(lengths > 0, lengths, 1), 1.0)


def diversify(query: np.ndarray, candidates: np.ndarray, alpha: float = 1.0) -> list[int]:
    """Keep the first candidate, then each that lies at least ``alpha`` times as far from all kept ones as from the query."""
    far = distances_to(query, candidates)
    kept: list[int] = []
    nearest = np.full(len(candidates), np.inf)
    for i in range(len(candidates)):
        if not kept or alpha * far[i] <= nearest[i]:
            kept.append(i)
            nearest = np.minimum(nearest, distances_to(candidates[i], candidates))
    return kept


def diversify_at_least(query: np.ndarray, candidates: np.ndarray, n: int, most: float = 1.0, least: float = 0.0, tolerance: float = 0.01) -> list[int]:
    """``diversify`` with the largest alpha, found by bisection, that still keeps ``n`` candidates; at ``least`` in the end."""
    low, high = least, most
    if len(diversify(query, candidates, high)) >= n:
        low = high
    while high - low > tolerance:
        middle = (low + high) / 2
        if len(diversify(query, candidates, middle)) >= n:
            low = middle
        else:
            high = middle
    return diversify(query, candidates, low)


#: Rows up to which a whole table of similarities is held; with more, rows of it are made when asked for, and facility
#: location looks at so many neighbours of each row.
DENSE_ROWS, NEIGHBOURS, _BLOCK = 4096, 512, 512


class Similarities:
    """As ``similarities`` of many rows, a row or a block at a time: memory grows with the rows, not with their square."""

    def __init__(self, x: np.ndarray):
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.unit = np.divide(x, norms, out=np.zeros_like(x, dtype=float), where=norms > 0)
        self.most = max((float((1 - self.unit[i : i + _BLOCK] @ self.unit.T).max()) for i in range(0, len(x), _BLOCK)), default=0.0)
        self.most = max(self.most, 0.0)

    def __len__(self) -> int:
        return len(self.unit)

    def __getitem__(self, i):
        """Row i, or the block of rows of a slice, or one cell."""
        if isinstance(i, tuple):
            return self.most - 1 + float(self.unit[i[0]] @ self.unit[i[1]])
        return self.most - 1 + self.unit[i] @ self.unit.T

    def sum(self, axis: int = 1) -> np.ndarray:
        return len(self.unit) * (self.most - 1) + self.unit @ self.unit.sum(axis=0)


class FacilityLocation:
    """Sum over all rows of their similarity to the nearest chosen one."""

    def __init__(self, similarity: np.ndarray | Similarities):
        self.similarity, self.covered = similarity, np.zeros(len(similarity))

    def gain(self, i: int) -> float:
        return float(np.maximum(self.similarity[i] - self.covered, 0).sum())

    def add(self, i: int) -> None:
        self.covered = np.maximum(self.covered, self.similarity[i])


class SparseFacilityLocation:
    """As ``FacilityLocation`` where a row has a similarity to its ``neighbours`` nearest rows alone, itself among them."""

    def __init__(self, similarity: Similarities, neighbours: int = NEIGHBOURS):
        n, k = len(similarity), min(neighbours, len(similarity))
        near, held = np.empty((n, k), dtype=np.int32), np.empty((n, k), dtype=np.float32)
        for i in range(0, n, _BLOCK):
            block = similarity[i : i + _BLOCK]
            block[np.arange(len(block)), np.arange(i, i + len(block))] = np.inf  # a row is its own nearest, before its copies
            near[i : i + _BLOCK] = np.argpartition(-block, k - 1, axis=1)[:, :k]
            block[np.arange(len(block)), np.arange(i, i + len(block))] = similarity.most
            held[i : i + _BLOCK] = np.take_along_axis(block, near[i : i + _BLOCK].astype(np.int64), axis=1)
        order = np.argsort(near.ravel(), kind="stable")
        self.rows, self.values = (order // k).astype(np.int32), held.ravel()[order]
        self.first = np.searchsorted(near.ravel()[order], np.arange(n + 1))
        self.covered = np.zeros(n)

    def gain(self, i: int) -> float:
        at = slice(self.first[i], self.first[i + 1])
        return float(np.maximum(self.values[at] - self.covered[self.rows[at]], 0).sum())

    def add(self, i: int) -> None:
        at = slice(self.first[i], self.first[i + 1])
        self.covered[self.rows[at]] = np.maximum(self.covered[self.rows[at]], self.values[at])


class SaturatedCoverage:
    """Sum over all rows of their similarity to the chosen ones, up to a share of that to all rows (Lin and Bilmes, 2011)."""

    def __init__(self, similarity: np.ndarray, share: float = 0.1):
        self.similarity, self.most, self.covered = similarity, share * similarity.sum(axis=1), np.zeros(len(similarity))

    def gain(self, i: int) -> float:
        return float((np.minimum(self.covered + self.similarity[i], self.most) - np.minimum(self.covered, self.most)).sum())

    def add(self, i: int) -> None:
        self.covered = self.covered + self.similarity[i]


class GraphCut:
    """Similarity of all rows to the chosen ones, less that among the chosen ones."""

    def __init__(self, similarity: np.ndarray, penalty: float = 1.0):
        self.similarity, self.total, self.among = similarity, similarity.sum(axis=1), np.zeros(len(similarity))
        self.penalty = penalty

    def gain(self, i: int) -> float:
        return float(self.total[i] - self.penalty * (2 * self.among[i] + self.similarity[i, i]))

    def add(self, i: int) -> None:
        self.among = self.among + self.similarity[i]


FUNCTIONS = {"facility_location": FacilityLocation, "saturated_coverage": SaturatedCoverage, "graph_cut": GraphCut}


def similarities(x: np.ndarray, dense_rows: int = DENSE_ROWS) -> np.ndarray | Similarities:
    """The largest cosine distance among the rows less each distance: at least 0."""
    if len(x) > dense_rows:
        return Similarities(x)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.divide(x, norms, out=np.zeros_like(x, dtype=float), where=norms > 0)
    far = 1 - unit @ unit.T
    return far.max(initial=0.0) - far


def _first_gains(state, similarity: np.ndarray | Similarities) -> list[float]:
    """What each row is worth before any is chosen."""
    if isinstance(state, FacilityLocation):
        return np.asarray(similarity.sum(axis=1)).tolist()
    if isinstance(state, SaturatedCoverage) and isinstance(similarity, Similarities):
        return [g for i in range(0, len(similarity), _BLOCK) for g in np.minimum(similarity[i : i + _BLOCK], state.most).sum(axis=1).tolist()]
    return [state.gain(i) for i in range(len(similarity))]


def submodular(similarity: np.ndarray | Similarities, n: int, function: str = "facility_location", cost: np.ndarray | None = None) -> list[int]:
    """``n`` rows by lazy greedy selection; with ``cost`` the largest gain for its cost comes first. Ties: the lower row."""
    if function not in FUNCTIONS:
        raise ValueError(f"no such submodular function: {function}")
    sparse = function == "facility_location" and isinstance(similarity, Similarities)
    state, price = (SparseFacilityLocation if sparse else FUNCTIONS[function])(similarity), np.ones(len(similarity)) if cost is None else np.maximum(cost, 1e-9)
    if n >= len(similarity):
        n = len(similarity)
    heap = [(-g / price[i], i) for i, g in enumerate(_first_gains(state, similarity))]
    heapq.heapify(heap)
    chosen: list[int] = []
    while heap and len(chosen) < n:
        _, i = heapq.heappop(heap)
        now = (-state.gain(i) / price[i], i)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        state.add(i)
        chosen.append(i)
    return chosen


def collapse_longest(phrases: list[str]) -> list[str]:
    """Each phrase gives way to a later or earlier one that begins or ends with it, words whole; repeats go, order stays."""
    out = list(phrases)
    for i, phrase in enumerate(out):
        for other in out:
            if other != phrase and (other.startswith(phrase + " ") or other.endswith(" " + phrase) or f" {phrase} " in other):
                phrase = other
        out[i] = phrase
    return list(dict.fromkeys(out))
