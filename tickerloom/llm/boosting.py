"""Small gradient-boosted trees for a bounded training set, and their form as SQL.

Trees are fitted on the driver with numpy from at most a few thousand rows (the caller's
documented bound) and then written out as nested CASE expressions, so that scoring stays inside
Spark's own expressions.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting with exact splits and Newton leaves."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.4, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.smooth = rounds, depth, rate, smooth
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, np.maximum(p * (1 - p), 1e-9), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _leaf(self, g, h, rows):
        return float(np.round(self.rate * g[rows].sum() / (h[rows].sum() + self.smooth), 6))

    def _grow(self, x, g, h, rows, depth):
        if depth == 0 or len(rows) < 8:
            return self._leaf(g, h, rows)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + self.smooth)
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + self.smooth) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + self.smooth) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, float(np.round((v[cut[k]] + v[cut[k] + 1]) / 2, 6)))
        _, f, at = best
        if f is None:
            return self._leaf(g, h, rows)
        low = x[rows, f] < at
        return f, at, self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, at, low, high = tree
        return np.where(x[:, f] < at, self._walk(low, x), self._walk(high, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._walk(t, x) for t in self.trees)

    def sql(self, names: list[str]) -> str:
        """The margin as SQL over the named features."""

        def text(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree:.6f}D"
            f, at, low, high = tree
            return f"if({names[f]} < {at:.6f}D, {text(low)}, {text(high)})"

        return " + ".join([f"{self.start:.6f}D", *map(text, self.trees)])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid: a and b of p = 1 / (1 + exp(-(a * margin + b))), by Newton steps on held-out rows."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, w = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(r * margin).sum() + 1e-3 * (a - 1), r.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability at which held-out precision reaches the aim; 1.1 (never) if none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & np.append(p[order][1:] < p[order][:-1], True))
    if not len(good):
        return 1.1
    last = good[-1]
    return float((p[order][last] + (p[order][last + 1] if last + 1 < len(p) else 0.0)) / 2)
