"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees as flat arrays. A leaf has feature -1; ``roots`` are the first nodes of the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``; walks all rows down each tree at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                split = self.feature[at]
                goes_left = x[rows, np.maximum(split, 0)] <= self.threshold[at]
                at = np.where(split < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_forest(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2,
    bins: int = 64, penalty: float = 1.0, least: int = 8,
) -> Forest:
    """Boost logistic loss. ``monotone`` holds -1, 0 or 1 for each feature.

    A split on a constrained feature counts only if its children's values lie in the allowed
    order, and the middle of the two bounds both subtrees, so that the whole forest is monotone.
    """
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    nodes: list[list[float]] = []
    roots = []
    margin = np.full(len(x), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + penalty), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, me, me, rate * leaf(total_g, total_h, low, high)])
        margin[rows] += nodes[me][4] if level == depth else 0
        if level == depth:
            return me
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            of = binned[rows, j]
            gs = np.cumsum(np.bincount(of, g[rows], len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(of, h[rows], len(cut) + 1))[:-1]
            n = np.cumsum(np.bincount(of, minlength=len(cut) + 1))[:-1]
            vl = np.clip(-gs / (hs + penalty), low, high)
            vr = np.clip(-(total_g - gs) / (total_h - hs + penalty), low, high)
            fine = (n >= least) & (len(rows) - n >= least) & (monotone[j] * (vr - vl) >= 0)
            # Loss at a clipped value v is g v + (h + penalty) v^2 / 2.
            gain = -(gs * vl + (hs + penalty) * vl**2 / 2) - ((total_g - gs) * vr + (total_h - hs + penalty) * vr**2 / 2)
            whole = leaf(total_g, total_h, low, high)
            gain = np.where(fine, gain + total_g * whole + (total_h + penalty) * whole**2 / 2, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            margin[rows] += nodes[me][4]
            return me
        middle = (vl + vr) / 2
        below = (low, middle) if monotone[j] > 0 else (middle, high) if monotone[j] < 0 else (low, high)
        above = (middle, high) if monotone[j] > 0 else (low, middle) if monotone[j] < 0 else (low, high)
        side = binned[rows, j] <= k
        nodes[me][:4] = [j, float(cuts[j][k]), -1, -1]
        nodes[me][2] = grow(rows[side], g, h, level + 1, *below)
        nodes[me][3] = grow(rows[~side], g, h, level + 1, *above)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    table = np.array(nodes, dtype=np.float64)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Forest(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots), base, depth)
