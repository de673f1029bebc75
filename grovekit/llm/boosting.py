"""Gradient boosted trees for two classes, small enough to be written as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))

    def sql(self, names: list[str]) -> str:
        if self.low is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {names[self.feature]} <= {self.cut!r}D THEN {self.low.sql(names)} ELSE {self.high.sql(names)} END"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int, ridge: float) -> Node:
    leaf = Node(value=float(round(rate * g.sum() / (h.sum() + ridge), 6)))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best, whole = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] != v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + ridge) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], *(_grow(x[s], g[s], h[s], depth - 1, rate, least, ridge) for s in (side, ~side)))


@dataclass
class Boosted:
    start: float
    trees: list[Node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        return " + ".join([f"{self.start!r}D", *[f"({t.sql(names)})" for t in self.trees]])


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss. y: 0 or 1, both present."""
    p = y.mean()
    model = Boosted(float(np.log(p / (1 - p))), [])
    m = np.full(len(y), model.start)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-m))
        tree = _grow(x, y - q, q * (1 - q), depth, rate, least, ridge)
        model.trees.append(tree)
        m += tree.predict(x)
    return model


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), fitted by Newton steps with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([margin, np.ones(len(y))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), z.T @ (t - p))
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the precision holds; above 1 if none does."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(y[order])
    ends = np.append(p[1:] != p[:-1], True)
    good = np.flatnonzero(ends & (hits / np.arange(1, len(p) + 1) >= precision))
    return float(p[good[-1]]) if len(good) else 2.0
