"""Gradient-boosted trees on a bounded sample, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf has a value; a split sends rows with feature <= cut to the left."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.cut, self.left.column(features)) \
            .otherwise(self.right.column(features))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.predict(x), self.right.predict(x))


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, rate: float, least: int) -> Node:
    g, h = gradient.sum(), weight.sum()
    leaf = Node(value=float(round(rate * g / (h + 1.0), 6)))
    best, gain = None, 1e-6
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            gl, hl = gradient[low].sum(), weight[low].sum()
            now = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if now > gain:
                best, gain = (f, int(cut), low), now
    if best is None:
        return leaf
    f, cut, low = best
    sides = (_grow(x[side], gradient[side], weight[side], depth - 1, rate, least) for side in (low, ~low))
    return Node(0.0, f, cut, *sides)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.4, least: int = 10) -> list[Node]:
    """Trees whose values sum to the log-odds of y, from integer features."""
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, y - p, p * (1 - p), depth, rate, least))
        score += trees[-1].predict(x)
    return trees


def scores(trees: list[Node], x: np.ndarray) -> np.ndarray:
    return sum((t.predict(x) for t in trees), np.zeros(len(x)))


def calibrated_cut(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out rows reach the precision; infinite if none does."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    good = last & (hits >= precision * np.arange(1, len(s) + 1)) & (hits > 0)
    return float(s[np.flatnonzero(good)[-1]]) if good.any() else float("inf")
