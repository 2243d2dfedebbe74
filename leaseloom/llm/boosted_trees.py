"""Gradient-boosted trees on histograms, with features whose influence may only fall; trained on a bounded sample, scored as node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of node arrays; `roots` are their first nodes. A leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), trees: int = 60, depth: int = 3, bins: int = 32,
          rate: float = 0.2, penalty: float = 1.0, least: float = 2.0) -> Forest:
    """Newton boosting of the log loss. A split on a `falling` feature keeps its low side's value at or above the high side's,
    and what lies below is held between them, so the score never rises with such a feature. No rows: even odds for everything."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, width), int)
    nodes: list[list[float]] = []
    roots, margin = [], np.full(n, bias)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        value = float(np.clip(-g.sum() / (h.sum() + penalty), low, high))
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(width if level < depth else 0):
            size = len(cuts[j])
            if not size:
                continue
            gs = np.cumsum(np.bincount(binned[rows, j], g, size + 1))
            hs = np.cumsum(np.bincount(binned[rows, j], h, size + 1))
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
            cost = lambda g, h, v: g * v + 0.5 * (h + penalty) * v * v
            gain = cost(gs[-1], hs[-1], value) - cost(gl, hl, vl) - cost(gr, hr, vr)
            gain[(hl < least) | (hr < least)] = -1
            if j in falling:
                gain[vl < vr] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j >= 0:
            goes_low = binned[rows, j] <= k
            middle = (vl + vr) / 2
            bounds = ((middle, high), (low, middle)) if j in falling else ((low, high), (low, high))
            nodes[me][:2] = [j, float(cuts[j][k])]
            nodes[me][2] = grow(rows[goes_low], level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes_low], level + 1, *bounds[1])
        else:
            margin[rows] += rate * value
        return me

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    table = np.array(nodes).reshape(-1, 5)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4],
                  np.array(roots, int), bias, depth)
