"""Histogram trees in numpy, grown on a bounded training table and flattened to arrays.

Columns are cut into bins at quantiles; a tree is grown level by level from
histograms of gradient and hessian sums by (node, column, bin).  A full binary
tree of fixed depth is three arrays (column, threshold, leaf value), so a batch of
rows descends all trees with a few vectorised steps a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Trees as arrays: ``column``/``threshold`` (trees, 2^depth - 1), ``leaf`` (trees, 2^depth)."""
    column: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Base plus the sum of the leaves that each row of ``x`` reaches."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for column, threshold, leaf in zip(self.column, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, column[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Bin edges of each column at quantiles of its distinct values."""
    out = []
    for c in x.T:
        u = np.unique(c)
        if len(u) > bins:
            u = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        out.append(u[:bins - 1])
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for c, e in zip(x.T, edges, strict=True)], axis=1)


def grow(b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float,
         columns: int | None = None, rng: np.random.Generator | None = None):
    """One tree on binned rows: gains from histograms, leaves -G / (H + l2).  With
    ``columns`` every node may use that many random columns only."""
    n, f = b.shape
    inner = 2 ** depth - 1
    column, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(n, np.int64)
    flat = b + np.arange(f) * BINS
    for level in range(depth):
        width, first = 2 ** level, 2 ** level - 1
        cell = ((node - first)[:, None] * (f * BINS) + flat).ravel()
        size = width * f * BINS
        hg = np.bincount(cell, np.repeat(g, f), size).reshape(width, f, BINS).cumsum(2)
        hh = np.bincount(cell, np.repeat(h, f), size).reshape(width, f, BINS).cumsum(2)
        tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):  # empty sides are set to 0 below
            gain = hg ** 2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg ** 2 / (th + l2)
        gain[(hh < least) | (th - hh < least)] = 0
        if columns is not None:
            for w in range(width):
                gain[w, rng.permutation(f)[columns:]] = 0
        best = gain.reshape(width, -1).argmax(1)
        for w in range(width):
            c, k = divmod(int(best[w]), BINS)
            if gain[w, c, k] > 1e-9 and k < len(edges[c]):
                column[first + w], threshold[first + w] = c, edges[c][k]
        cut = np.array([np.searchsorted(edges[c], t, "left") if np.isfinite(t) else BINS for c, t in zip(column, threshold, strict=True)])
        node = 2 * node + 1 + (b[np.arange(n), column[node]] > cut[node])
    at = node - inner
    gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
    return column, threshold, np.where(hs > 0, -gs / np.maximum(hs + l2, 1e-12), 0.0), at


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0,
          least: float = 5.0) -> Forest:
    """Gradient boosting of the logistic loss; without both labels the share of label 1 alone."""
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(p / (1 - p)))
    none = np.zeros((0, 2 ** depth - 1))
    if len(np.unique(y)) < 2:
        return Forest(none.astype(int), none, np.zeros((0, 2 ** depth)), base, depth)
    edges = cuts(x)
    b = binned(x, edges)
    raw = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        c, t, leaf, at = grow(b, edges, q - y, q * (1 - q), depth, l2, least * 0.05)
        trees.append((c, t, rate * leaf))
        raw += rate * leaf[at]
    return Forest(*(np.stack(z) for z in zip(*trees, strict=True)), base, depth)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 7, seed: int = 7) -> Forest:
    """Trees on bootstrap weights and random columns; ``raw`` is the mean share of label 1
    (the split gain on 0/1 labels is the decrease of Gini impurity)."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return Forest(np.zeros((0, 2 ** depth - 1), int), np.zeros((0, 2 ** depth - 1)), np.zeros((0, 2 ** depth)), 0.0, depth)
    edges = cuts(x)
    b = binned(x, edges)
    some = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    out = []
    for _ in range(trees):
        w = rng.poisson(1.0, len(y)).astype(float)
        c, t, leaf, _ = grow(b, edges, -y * w, w, depth, 0.0, 1.0, some, rng)
        out.append((c, t, leaf / trees))
    return Forest(*(np.stack(z) for z in zip(*out, strict=True)), 0.0, depth)
