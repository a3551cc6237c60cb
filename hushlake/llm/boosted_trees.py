"""Small gradient-boosted trees that are fitted on the driver and run as Spark
expressions.  They serve candidates, which are few, not texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Logistic loss, trees of depth two, splits at midpoints of seen values."""

    def __init__(self, rounds: int = 30, rate: float = 0.4):
        self.rounds, self.rate = rounds, rate
        self.trees: list[tuple] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.bias)
        cuts = [(v[1:] + v[:-1]) / 2 for v in (np.unique(x[:, j]) for j in range(x.shape[1]))]

        def leaf(rows, g, h):
            return self.rate * float(g[rows].sum() / (h[rows].sum() + 1.0))

        def split(rows, g, h):
            best = (0.0, None, None)
            base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for j, values in enumerate(cuts):
                for c in values:
                    left = rows & (x[:, j] <= c)
                    right = rows & ~left
                    if left.any() and right.any():
                        gain = (
                            g[left].sum() ** 2 / (h[left].sum() + 1.0)
                            + g[right].sum() ** 2 / (h[right].sum() + 1.0)
                            - base
                        )
                        if gain > best[0] + 1e-9:
                            best = (gain, j, float(c))
            return best[1:]

        def node(rows, g, h, depth):
            j, c = split(rows, g, h) if depth else (None, None)
            if j is None:
                return leaf(rows, g, h)
            left = rows & (x[:, j] <= c)
            return (j, c, node(left, g, h, depth - 1), node(rows & ~left, g, h, depth - 1))

        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = node(np.ones(len(y), bool), y - p, p * (1 - p), 2)
            self.trees.append(tree)
            score += self._run(tree, x)
        return self

    def _run(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._run(low, x), self._run(high, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._run(t, x) for t in self.trees)

    def expression(self, features: list[Column]) -> Column:
        """The same score as a Spark expression of the features."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, c, low, high = tree
            return F.when(features[j] <= c, of(low)).otherwise(of(high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + of(tree)
        return total


def calibrated(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least threshold above which held-out candidates reach ``precision``."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    # all of one score stand or fall together
    for last in good[::-1]:
        if last + 1 == len(order) or scores[order[last + 1]] < scores[order[last]]:
            return float(scores[order[last]])
    return float("inf")
