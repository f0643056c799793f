"""Gradient boosted trees for two classes, fitted on the driver on a bounded sample, applied as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, cut, left, right) or a leaf's value


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> Tree | float:
    leaf = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best = (1e-9, None)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, cg, ch = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - base
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (k, float((v[at[i]] + v[at[i] + 1]) / 2)))
    if best[1] is None:
        return leaf
    k, cut = best[1]
    low = x[:, k] <= cut
    return (k, cut, _grow(x[low], g[low], h[low], depth - 1, least), _grow(x[~low], g[~low], h[~low], depth - 1, least))


def _apply(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, cut, low, high = tree
    return np.where(x[:, k] <= cut, _apply(low, x), _apply(high, x))


class Boosted:
    """start + rate * sum of trees, through the logistic function."""

    def __init__(self, start: float, rate: float, trees: list) -> None:
        self.start, self.rate, self.trees = start, rate, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self = cls(math.log(p / (1 - p)), rate, [])
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            tree = _grow(x, y - q, q * (1 - q), depth, least)
            self.trees.append(tree)
            f += rate * _apply(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = self.start + self.rate * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))

    def column(self, features: list[Column]) -> Column:
        """The same score as an expression, one CASE for each tree."""

        def case(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            k, cut, low, high = tree
            return F.when(features[k] <= cut, case(low)).otherwise(case(high))

        f = F.lit(self.start)
        for tree in self.trees:
            f = f + F.lit(self.rate) * case(tree)
        return 1 / (1 + F.exp(-f))


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on at least this share of the held-out rows is positive; above 1 if none is."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    good = hits / np.arange(1, len(s) + 1) >= precision
    last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)  # rows of one score go together
    at = np.flatnonzero(good & last)
    return float(s[at[-1]]) if len(at) else 2.0
