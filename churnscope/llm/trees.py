"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays.

Every tree is complete: the node ``i`` of a level has the children ``2i + 1``
and ``2i + 2``, so one array per field holds a tree and all rows walk down
together.  Fitting takes a bounded sample (see ``quality.SAMPLE``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right above it; inf: always left
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x, y, monotone, trees: int = 80, depth: int = 3, bins: int = 64, rate: float = 0.2, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic boosting; ``monotone[j]`` is 1, -1 or 0: the direction in which feature ``j`` may move the score."""
    n, m = x.shape if x.ndim == 2 else (0, len(monotone))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        base = 4.0 if n == 0 or y[0] == 1 else -4.0
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)])  # > cut k exactly where code > k
    rate0 = y.mean()
    base = float(np.log(rate0 / (1 - rate0)))
    f = np.full(n, base)
    fields = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for i in range((1 << level) - 1, (2 << level) - 1):
                at = np.flatnonzero(node == i)
                best, choice, mid = 1e-6, None, 0.0
                for j in range(m) if len(at) else ():
                    c = code[j, at]
                    size = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(c, weights=g[at], minlength=size))
                    hl = np.cumsum(np.bincount(c, weights=h[at], minlength=size))
                    gr, hr = gl[-1] - gl[:-1], hl[-1] - hl[:-1]
                    total, gl, hl = gl[-1] ** 2 / (hl[-1] + ridge), gl[:-1], hl[:-1]
                    vl, vr = (np.clip(a / (b + ridge), low[i], high[i]) for a, b in ((gl, hl), (gr, hr)))
                    gain = 2 * gl * vl - (hl + ridge) * vl**2 + 2 * gr * vr - (hr + ridge) * vr**2 - total
                    gain[(hl < least) | (hr < least) | (monotone[j] * (vr - vl) < 0)] = 0
                    if len(gain) and gain.max() > best:
                        k = int(gain.argmax())
                        best, choice, mid = gain[k], (j, k), (vl[k] + vr[k]) / 2
                left, right = 2 * i + 1, 2 * i + 2
                low[[left, right]], high[[left, right]] = low[i], high[i]
                if choice is None:
                    node[at] = left
                    continue
                j, k = choice
                feature[i], threshold[i] = j, cuts[j][k]
                if monotone[j]:
                    a, b = (left, right) if monotone[j] > 0 else (right, left)
                    high[a], low[b] = min(high[a], mid), max(low[b], mid)
                node[at] = np.where(code[j, at] > k, right, left)
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        value = rate * np.clip(gs / (hs + ridge), low[inner:], high[inner:])
        f += value[leaf]
        for held, new in zip(fields, (feature, threshold, value)):
            held.append(new)
    return Trees(*map(np.array, fields), base)
