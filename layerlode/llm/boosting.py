"""Gradient-boosted trees for a binary outcome on binned features, and isotonic calibration, in numpy.

Models are fitted on a bounded sample on the driver; prediction runs on arrays inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 and 2i + 2. A leaf has the feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Boosted:
    """Logistic boosting with histogram splits (Friedman, 2001)."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    least_rows: int = 10
    penalty: float = 1.0
    base: float = 0.0
    grown: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.grown = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, edges, y - p, p * (1 - p))
            score += tree.value[leaf]
            self.grown.append(tree)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[Tree, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        node = np.zeros(len(g), dtype=np.int64)
        for i in range(size):
            at = np.flatnonzero(node == i)
            if not len(at):
                continue
            gs, hs = g[at].sum(), h[at].sum()
            tree.value[i] = self.rate * gs / (hs + self.penalty)
            if i >= size // 2 or len(at) < 2 * self.least_rows:
                continue
            best = (1e-9, -1, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[at, f]
                gl = np.cumsum(np.bincount(b, g[at], minlength=len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[at], minlength=len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(nl < self.least_rows) | (len(at) - nl < self.least_rows)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            tree.feature[i], tree.cut[i] = f, edges[f][k]
            node[at] = np.where(binned[at, f] <= k, 2 * i + 1, 2 * i + 2)
        return tree, node

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.grown:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = tree.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= tree.cut[node], 2 * node + 1, 2 * node + 2)
                node = np.where(f >= 0, down, node)
            out += tree.value[node]
        return out


@dataclass
class Isotonic:
    """A non-decreasing step fit by pooling adjacent violators; between its points it is linear."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, scores: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.lexsort((y, scores))
        s, y = scores[order], y[order].astype(float)
        first = np.flatnonzero(np.diff(s, prepend=np.nan) != 0)
        n = np.diff(first, append=len(s)).astype(float)
        means = np.add.reduceat(y, first) / n if len(s) else y
        blocks: list[list[float]] = []
        for lo, v, w in zip(s[first], means, n, strict=True):
            blocks.append([v, w, lo, lo])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v2, w2, _, hi = blocks.pop()
                v1, w1, lo1, _ = blocks.pop()
                blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo1, hi])
        self.x = np.array([e for b in blocks for e in (b[2], b[3])])
        self.y = np.array([b[0] for b in blocks for _ in range(2)])
        return self

    def predict(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y) if len(self.x) else np.full(len(scores), np.nan)
