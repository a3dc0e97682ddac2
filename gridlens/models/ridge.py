"""Ridge regression from sums alone: a whole path of weights from one eigendecomposition, and the
weight chosen by rows that the fit has not seen."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from gridlens.models.lagged import Moments

#: Weights that are tried, as shares of the variance of one input.
WEIGHTS = tuple(10.0**k for k in range(-6, 3))


class Path:
    """Solutions for every weight. Inputs are brought to unit spread; those that never move get 0."""

    def __init__(self, sums: Moments) -> None:
        self.mx, self.my = sums.sx / sums.n, sums.sy / sums.n
        xx, xy, _ = sums.about(self.mx, self.my)
        spread = np.sqrt(np.clip(np.diag(xx) / sums.n, 0.0, None))
        size = np.sqrt(np.clip(np.diag(sums.xx) / sums.n, 0.0, None))
        self.moves = spread > 1e-7 * np.maximum(size, 1e-300)
        self.unit = np.where(self.moves, spread, 1.0)
        a = xx / sums.n / np.outer(self.unit, self.unit)
        a[~self.moves] = 0.0
        a[:, ~self.moves] = 0.0
        self.value, self.vector = np.linalg.eigh(a)
        self.value = np.clip(self.value, 0.0, None)
        self.response = self.vector.T @ np.where(self.moves, xy.T / sums.n / self.unit, 0.0).T

    def turned(self, weight: float) -> np.ndarray:
        """Coefficients along the eigenvectors."""
        return self.response / (self.value + weight)[:, None]

    def coefficients(self, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """(intercept a target, coefficients input × target)."""
        coef = (self.vector @ self.turned(weight)) / self.unit[:, None]
        return self.my - self.mx @ coef, coef

    def losses(self, seen: Moments, weights: Sequence[float]) -> np.ndarray:
        """For each weight the sum of squared errors over the rows behind ``seen``."""
        xx, xy, yy = seen.about(self.mx, self.my)
        axes = self.vector / self.unit[:, None]
        h, g = axes.T @ xx @ axes, axes.T @ xy
        out = []
        for weight in weights:
            q = self.turned(weight)
            out.append(float((q * (h @ q)).sum() - 2 * (q * g).sum() + yy.sum()))
        return np.array(out)


def choose_and_fit(train: Moments | None, held: Moments | None, every: Moments,
                   weights: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """The weight with the least held-out error, the larger of equals, and a fit to all rows with it.

    Without rows on both sides there is nothing to choose by: the middle weight is taken.
    """
    weights = sorted(weights, reverse=True)
    if len(weights) == 1 or train is None or held is None:
        weight = weights[len(weights) // 2]
    else:
        weight = weights[int(np.argmin(Path(train).losses(held, weights)))]
    return weight, *Path(every).coefficients(weight)
