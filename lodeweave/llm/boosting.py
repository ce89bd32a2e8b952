"""Small tree ensembles in numpy: gradient-boosted trees, a random forest, and isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Quantile edges of each column; a value's bin is the number of edges below it."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8) if x.shape[1] else np.zeros(x.shape, np.uint8)


class Tree:
    """A binary tree over binned columns: rows with bin <= cut go left. Leaves hold values."""

    def __init__(self) -> None:
        self.column, self.cut, self.left, self.value = [], [], [], []

    def add(self) -> int:
        for a, v in ((self.column, -1), (self.cut, 0), (self.left, -1), (self.value, 0.0)):
            a.append(v)
        return len(self.column) - 1

    def freeze(self) -> Tree:
        self.column, self.cut, self.left, self.value = np.array(self.column), np.array(self.cut), np.array(self.left), np.array(self.value)
        return self

    def predict(self, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), dtype=np.int64)
        rows = np.arange(len(b))
        while (inner := self.column[at] >= 0).any():
            r = rows[inner]
            a = at[r]
            at[r] = self.left[a] + (b[r, self.column[a]] > self.cut[a])
        return self.value[at]


def grow(b: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, least: float, columns=None, ridge: float = 1.0) -> Tree:
    """A tree that lowers sum(gradient)^2 / (sum(weight) + ridge) most at each split; leaves hold gradient / weight."""
    tree, n_columns = Tree(), b.shape[1]
    todo = [(tree.add(), np.arange(len(b)), 0)]
    while todo:
        node, rows, level = todo.pop()
        g, w = gradient[rows].sum(), weight[rows].sum()
        tree.value[node] = g / (w + ridge)
        if level == depth or w < 2 * least:
            continue
        use = columns() if columns else np.arange(n_columns)
        flat = (b[np.ix_(rows, use)].astype(np.int64) + np.arange(len(use)) * (BINS + 1)).ravel()
        size = len(use) * (BINS + 1)
        gs = np.bincount(flat, np.repeat(gradient[rows], len(use)), size).reshape(len(use), -1).cumsum(axis=1)[:, :-1]
        ws = np.bincount(flat, np.repeat(weight[rows], len(use)), size).reshape(len(use), -1).cumsum(axis=1)[:, :-1]
        gain = gs**2 / (ws + ridge) + (g - gs) ** 2 / (w - ws + ridge) - g * g / (w + ridge)
        gain[(ws < least) | (w - ws < least)] = -1
        best = int(gain.argmax())
        if gain.flat[best] <= 1e-9:
            continue
        column, cut = int(use[best // BINS]), best % BINS
        right = b[rows, column] > cut
        tree.column[node], tree.cut[node] = column, cut
        tree.left[node] = tree.add()
        tree.add()
        todo += [(tree.left[node], rows[~right], level + 1), (tree.left[node] + 1, rows[right], level + 1)]
    return tree.freeze()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BoostedTrees:
    """Gradient boosting of logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.1, least: float = 1.0) -> BoostedTrees:
        self.edges, self.rate = bin_edges(x), rate
        b, mean = to_bins(x, self.edges), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        z, self.trees = np.full(len(y), self.start), []
        for _ in range(trees):
            p = sigmoid(z)
            tree = grow(b, y - p, p * (1 - p), depth, least)
            self.trees.append(tree)
            z += rate * tree.predict(b)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = to_bins(x, self.edges)
        return self.start + self.rate * sum((t.predict(b) for t in self.trees), np.zeros(len(x)))


class RandomForest:
    """Probability trees on bootstrap rows, with a random third of the columns at each split."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 9, seed: int = 3) -> RandomForest:
        rng = np.random.default_rng(seed)
        self.edges = bin_edges(x)
        b, n, k = to_bins(x, self.edges), len(y), x.shape[1]
        some = lambda: rng.choice(k, max(1, k // 3), replace=False)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, n, n)
            self.trees.append(grow(b[rows], y[rows].astype(float), np.ones(n), depth, 2.0, some, 1e-6))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = to_bins(x, self.edges)
        return np.mean([t.predict(b) for t in self.trees], axis=0) if len(x) else np.zeros(0)


class Isotonic:
    """Pool-adjacent-violators fit of y on x, non-decreasing, with linear steps between the pools."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # mean, weight, sum of x
        for xi, yi in zip(x[order], y[order], strict=True):
            pools.append([float(yi), 1.0, float(xi)])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                m, w, s = pools.pop()
                pools[-1] = [(pools[-1][0] * pools[-1][1] + m * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2] + s]
        self.x, self.y = np.array([s / w for _, w, s in pools]), np.array([m for m, _, _ in pools])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.full(len(x), 0.5)
