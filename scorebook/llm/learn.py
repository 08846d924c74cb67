"""Small models fitted on bounded samples: logistic regression, boosted trees, calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def mean_one(counts: np.ndarray) -> np.ndarray:
    return counts / counts.mean() if len(counts) else counts


class SparseRows:
    """Rows of (index, value) pairs in one flat pair of arrays."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]):
        self.starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        self.index = np.concatenate([i for i, _ in rows] or [np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([v for _, v in rows] or [np.empty(0)]).astype(np.float64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.starts))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], len(self))

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, self.value * errors[self.row], size)


def logistic(
    rows: SparseRows, labels: np.ndarray, size: int, penalty: float = 1.0, steps: int = 120, counts: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-penalised logistic regression, by accelerated gradient steps; row i counts `counts[i]` times."""
    n = max(len(rows), 1)
    counts = mean_one(np.ones(n) if counts is None else counts)
    weights, bias = np.zeros(size), 0.0
    ahead, ahead_bias = weights.copy(), bias
    norms = np.bincount(rows.row, rows.value**2, len(rows)) if len(rows) else np.zeros(1)
    rate = 4.0 / (norms.max() + 1.0 + 4.0 * penalty / n)
    for step in range(steps):
        error = counts * (labels - sigmoid(rows.dot(ahead) + ahead_bias))
        gradient = rows.back(error, size) / n - penalty / n * ahead
        new, new_bias = ahead + rate * gradient, ahead_bias + rate * error.mean()
        momentum = step / (step + 3.0)
        ahead, ahead_bias = new + momentum * (new - weights), new_bias + momentum * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 60, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton steps; row i counts `counts[i]` times."""
    counts = mean_one(np.ones(len(labels)) if counts is None else counts)
    positives = labels.sum()
    target = np.where(labels > 0, (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2))
    x = np.stack([scores, np.ones_like(scores)])
    fit = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(fit @ x)
        slope = x @ (counts * (target - p)) - 1e-3 * (fit - [1.0, 0.0])
        curve = (x * (counts * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        fit = fit + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(fit[0]), float(fit[1])


class BoostedTrees:
    """Gradient boosting of shallow trees on the logistic loss with quantile cuts."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, cuts: int = 24, least: int = 8):
        self.rounds, self.depth, self.rate, self.cuts, self.least = rounds, depth, rate, cuts, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree, leaf = self._grow(binned, edges, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += np.array([node[2] for node in tree])[leaf]
        return self

    def _grow(self, binned, edges, residual, weight):
        """A complete tree as (feature, cut, value) nodes; feature -1 is a leaf."""
        nodes = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        where = np.zeros(len(residual), np.int64)
        for node in range(len(nodes)):
            rows = np.flatnonzero(where == node)
            value = self.rate * residual[rows].sum() / (weight[rows].sum() + 1.0) if len(rows) else 0.0
            nodes[node] = (-1, 0.0, float(value))
            if 2 * node + 2 >= len(nodes) or len(rows) < 2 * self.least:
                continue
            best = (1e-6, -1, -1)
            g, h = residual[rows], weight[rows]
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gs = np.bincount(b, g, len(e) + 1).cumsum()[:-1]
                hs = np.bincount(b, h, len(e) + 1).cumsum()[:-1]
                ns = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                _, f, k = best
                nodes[node] = (f, float(edges[f][k]), float(value))
                where[rows] = 2 * node + 1 + (binned[rows, f] > k)
        return nodes, where

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            feature = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, 2 * at + 1 + right, at)
            total += np.array([t[2] for t in tree])[at]
        return total
