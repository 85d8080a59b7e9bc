"""Logistic regression and calibration for sparse binary features, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Sparse:
    """Rows of feature indices, each with the value 1. Products go over blocks of entries, so that they take little memory."""

    BLOCK = 1 << 19

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, width: int):
        """``sizes``: entries of each row; ``columns`` of the entries, row after row."""
        self.sizes, self.columns, self.shape = sizes, columns.astype(np.int32, copy=False), (len(sizes), width)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        cuts = np.searchsorted(self.starts, np.arange(0, self.starts[-1], self.BLOCK))
        self.cuts = np.unique(np.concatenate(([0], cuts, [len(sizes)])))

    def take(self, mask: np.ndarray) -> Sparse:
        return Sparse(self.sizes[mask], self.columns[np.repeat(mask, self.sizes)], self.shape[1])

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for a, b in zip(self.cuts.tolist(), self.cuts[1:].tolist(), strict=False):
            yield slice(a, b), self.columns[self.starts[a] : self.starts[b]]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for rows, columns in self._blocks():
            some = np.flatnonzero(self.sizes[rows])
            if len(some):
                out[rows.start + some] = np.add.reduceat(weights[columns], self.starts[rows][some] - self.starts[rows.start])
        return out

    def tdot(self, residuals: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for rows, columns in self._blocks():
            out += np.bincount(columns, np.repeat(residuals[rows], self.sizes[rows]), minlength=self.shape[1])
        return out


def fit_logistic(
    x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float, start: tuple[np.ndarray, float] | None = None, steps: int = 60
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent with a step from a bound of the curvature.

    ``y`` may be probabilities; ``start`` is a fit to go on from. Without rows, or with one class only, the weights are 0.
    """
    n, d = x.shape
    total = weight.sum()
    if not n or not total:
        return np.zeros(d), 0.0
    mean = float((weight * y).sum() / total)
    b = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    w = np.zeros(d)
    if mean in (0.0, 1.0):
        return w, b
    if start is not None:
        w, b = start
    # Curvature along each coordinate, at most a quarter of its weighted sum of the entries its rows have.
    reach = x.sizes + 1
    bound = x.tdot(weight * reach) / (4 * total) + l2
    bound_b = float((weight * reach).sum() / (4 * total))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = weight * (sigmoid(x.dot(vw) + vb) - y) / total
        nw = vw - (x.tdot(r) + l2 * vw) / bound
        nb = vb - r.sum() / bound_b
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b)
        w, b, t = nw, nb, s
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-6, steps: int = 30) -> np.ndarray:
    """Weights of a small dense logistic regression by Newton's method; the last one is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    if not len(x) or y.min() == y.max():
        w[-1] = 0.0 if not len(x) else np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        return w
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) / len(x) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
