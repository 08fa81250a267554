"""Logistic regression on a bounded sample, for models whose rows fit one process."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows of ones: the columns of row ``k`` are ``cols[ends[k-1]:ends[k]]``."""

    cols: np.ndarray
    ends: np.ndarray
    width: int

    @classmethod
    def of(cls, lists: list[np.ndarray], width: int) -> Rows:
        cols = np.concatenate([np.empty(0, dtype=np.int64), *lists]).astype(np.int64)
        return cls(cols, np.cumsum([len(x) for x in lists], dtype=np.int64), width)

    def __len__(self) -> int:
        return len(self.ends)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.ends, prepend=0))

    def take(self, which: np.ndarray) -> Rows:
        keep = which[self.row_of()]
        return Rows(self.cols[keep], np.cumsum(np.diff(self.ends, prepend=0)[which]), self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_logistic(
    rows: Rows, extra: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse columns, of the dense ``extra`` columns, and the intercept.

    Newton's method with conjugate gradients; the intercept is not penalised. With one class
    only (or no rows) all weights are 0 and the intercept is the smoothed share.
    """
    n, positive = len(y), float(y.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    w = np.zeros(rows.width + extra.shape[1] + 1)
    w[-1] = bias
    if positive in (0.0, float(n)):
        return w[: rows.width], w[rows.width : -1], bias
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    # by row and by column, so that both products are sums over neighbours
    size = np.diff(rows.ends, prepend=0)
    row_by_col = rows.row_of()[np.argsort(rows.cols, kind="stable")]
    in_col = np.bincount(rows.cols, minlength=rows.width)

    def sums(values, count):
        out = np.zeros(len(count))
        some = count > 0
        if some.any():
            out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some])
        return out

    def apply(v):
        return sums(v[rows.cols], size) + extra @ v[rows.width : -1] + v[-1]

    def back(r):
        return np.concatenate([sums(r[row_by_col], in_col), extra.T @ r, [r.sum()]])

    def loss(v):
        z = apply(v)
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * v * v).sum()

    for _ in range(steps):
        p = sigmoid(apply(w))
        gradient = back(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-3:
            break
        curve = np.maximum(p * (1 - p), 1e-9)
        step, residual = np.zeros_like(w), -gradient
        direction, length = residual.copy(), residual @ residual
        # a rough step far from the optimum, a good one near it
        enough = min(0.01, np.sqrt(length) / n) * length
        for _ in range(30):
            h = back(curve * apply(direction)) + penalty * direction
            alpha = length / (direction @ h)
            step += alpha * direction
            residual = residual - alpha * h
            new = residual @ residual
            if new < enough:
                break
            direction, length = residual + (new / length) * direction, new
        scale, before = 1.0, loss(w)
        while loss(w + scale * step) > before and scale > 1e-3:
            scale /= 2
        w = w + scale * step
    return w[: rows.width], w[rows.width : -1], float(w[-1])
