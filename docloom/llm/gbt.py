"""Gradient-boosted trees: fitted on rows or on counted cells, flattened into node arrays, scored by numpy or as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays. Node i sends x to ``left[i]`` if x[feature[i]] <= threshold[i], else to ``right[i]``; leaves have feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at]))
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def sql(self, names: list[str]) -> str:
        """The log odds as SQL over columns ``names``."""

        def node(i: int) -> str:
            if self.feature[i] < 0:
                return f"{float(self.value[i])!r}D"
            return f"IF({names[self.feature[i]]} <= {float(self.threshold[i])!r}D, {node(self.left[i])}, {node(self.right[i])})"

        return " + ".join([f"{float(self.base)!r}D", *(node(int(r)) for r in self.roots)])


def fit(x: np.ndarray, y: np.ndarray, *, weights: np.ndarray | None = None, edges: list[list[float]] | None = None, monotone: list[int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 20, l2: float = 1.0, bins: int = 64) -> Forest:
    """Logistic boosting over binned features. ``weights``: how many rows each row stands for; ``edges``: where to bin, else at quantiles.

    ``monotone[f]`` is 1 (the score never falls with f), -1 (it never rises) or 0. Such a split must order its two values, and
    each side is bounded by their mean further down, so whole trees keep the order.
    """
    n, k = x.shape
    monotone = monotone or [0] * k
    every = np.ones(n) if weights is None else weights.astype(float)
    edges = [np.array(e, float) for e in edges] if edges else [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)], axis=1)
    share = min(max(float(np.average(y, weights=every)), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, room: int, low: float, high: float) -> int:
        me = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, me), (right, me), (value, 0.0)):
            a.append(v)
        gs, hs = g[rows].sum(), h[rows].sum()
        best: tuple | None = None
        for f in range(k) if room and every[rows].sum() >= 2 * least else ():
            if not len(edges[f]):
                continue
            b, size = binned[rows, f], len(edges[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], every[rows]))
            vl, vr = (np.clip(-p / (q + l2), low, high) for p, q in ((gl, hl), (gs - gl, hs - hl)))
            # what the loss falls by with these values
            gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + l2) * vr**2)
            gain[(nl < least) | (every[rows].sum() - nl < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
            c = int(np.argmax(gain))
            if np.isfinite(gain[c]) and (best is None or gain[c] > best[0]):
                best = (gain[c], f, c, vl[c], vr[c])
        own = float(np.clip(-gs / (hs + l2), low, high))
        if best is None or best[0] <= -(gs * own + 0.5 * (hs + l2) * own**2) + 1e-9:
            value[me] = rate * own
            margin[rows] += rate * own
            return me
        _, f, c, vl, vr = best
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[f]]
        goes = binned[rows, f] <= c
        feature[me], threshold[me] = f, float(edges[f][c])
        left[me] = grow(rows[goes], g, h, room - 1, *bounds[0])
        right[me] = grow(rows[~goes], g, h, room - 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), every * (p - y), every * np.maximum(p * (1 - p), 1e-6), depth, -4.0, 4.0))
    ints = lambda a: np.array(a, np.int64)
    return Forest(ints(roots), ints(feature), np.array(threshold), ints(left), ints(right), np.array(value), base, depth)
