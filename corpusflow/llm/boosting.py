"""Gradient-boosted trees and probability calibration for small bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 60, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) with sigmoid(a * margin + b) near the label's probability (Newton steps)."""
    weight = np.ones_like(margin) if weight is None else weight
    hits, misses = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label > 0, (hits + 1) / (hits + 2), 1 / (misses + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - target)) + 1e-6 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


@dataclass
class BoostedTrees:
    """Trees of logistic loss over few features; splits at midpoints of up to
    ``bins`` quantiles. Deterministic: no sampling, ties go to the first feature."""

    n_trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    leaf_weight: float = 1.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, edges: list | None = None) -> BoostedTrees:
        """``weight`` rows of each kind; ``edges`` are the splits of every feature, if known."""
        self.edges = edges or [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        weight = np.ones(len(y)) if weight is None else weight
        codes = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = sigmoid(margin)
            tree = self._grow(codes, weight * (y - p), weight * p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._run(tree, x)
        return self

    def _grow(self, codes, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-9, None, None)
        if depth:
            for j, edges in enumerate(self.edges):
                n = len(edges) + 1
                gs = np.cumsum(np.bincount(codes[rows, j], grad[rows], n))[:-1]
                hs = np.cumsum(np.bincount(codes[rows, j], hess[rows], n))[:-1]
                if not len(gs):
                    continue
                k = self.leaf_weight
                gain = gs ** 2 / (hs + k) + (g - gs) ** 2 / (h - hs + k) - g ** 2 / (h + k)
                gain[(hs < 1e-3) | (h - hs < 1e-3)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (gain[i], j, i)
        if best[1] is None:
            return self.rate * g / (h + self.leaf_weight)
        _, j, i = best
        left = codes[rows, j] <= i
        return (j, self.edges[j][i], self._grow(codes, grad, hess, rows[left], depth - 1),
                self._grow(codes, grad, hess, rows[~left], depth - 1))

    def _run(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, edge, low, high = tree
        out, left = np.empty(len(x)), x[:, j] < edge
        out[left], out[~left] = self._run(low, x[left]), self._run(high, x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._run(t, x) for t in self.trees), np.zeros(len(x)))
