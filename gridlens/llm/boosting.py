"""Gradient-boosted trees for two classes, on binned numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Each tree is (feature, cut, left, right, value) arrays; a leaf has feature -1."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                r, k = rows[inner], at[inner]
                at[inner] = np.where(x[r, feature[k]] <= cut[k], left[k], right[k])
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10) -> BoostedTrees:
    """Logistic loss with second-order steps. ``y`` is 0 or 1."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = BoostedTrees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    binned = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    score = np.full(len(y), model.start)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, left, right, value = [], [], [], [], []

        def add(rows: np.ndarray, level: int) -> int:
            me = len(feature)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, rate * total_g / (total_h + 1))):
                a.append(v)
            best, gain = None, 1e-3
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    b = binned[f][rows]
                    if not len(c) or b[0] == b.min() == b.max():
                        continue
                    n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                    gl = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1]
                    hl = np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                    worth = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    worth = np.where((n >= least) & (len(rows) - n >= least), worth, -1.0)
                    if len(worth) and worth.max() > gain:
                        k = int(worth.argmax())
                        best, gain = (f, k), worth[k]
            if best:
                f, k = best
                feature[me], cut[me] = f, cuts[f][k]
                low = binned[f][rows] <= k
                left[me] = add(rows[low], level + 1)
                right[me] = add(rows[~low], level + 1)
            return me

        add(np.arange(len(y)), 0)
        tree = tuple(np.array(a) for a in (feature, cut, left, right, value))
        model.trees.append(tree)
        score = score + BoostedTrees(0.0, [tree]).log_odds(x)
    return model
