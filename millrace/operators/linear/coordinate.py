"""Lasso and elastic net: coordinate descent on the Gram matrix, so that iterations cost no job."""

from __future__ import annotations

import numpy as np

from ..base import ConvergenceWarning, warn
from .gram import gram
from .least_squares import LinearModel


def descend(g: np.ndarray, q: np.ndarray, l1: float, l2: float, b: np.ndarray, positive: bool, max_iter: int, tol: float) -> tuple[np.ndarray, int, bool]:
    """Cyclic updates of 1/2 b'Gb - q'b + l1|b| + l2/2 |b|^2 until no coefficient moves by tol * max(1, max|b|)."""
    b = b.copy()
    gb = g @ b
    for it in range(1, max_iter + 1):
        moved = 0.0
        for j in range(len(b)):
            d = g[j, j] + l2
            if d == 0:
                continue
            rho = q[j] - gb[j] + g[j, j] * b[j]
            new = max(rho - l1, 0.0) if positive else np.sign(rho) * max(abs(rho) - l1, 0.0)
            new /= d
            if new != b[j]:
                gb += g[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved <= tol * max(1.0, np.abs(b).max(initial=0.0)):
            return b, it, True
    return b, max_iter, False


def dual_gap(g, q, t, b, l1, l2, positive) -> float:
    """Primal minus dual value at the scaled residual, from the Gram alone."""
    slack = q - g @ b - l2 * b
    top = slack.max(initial=0.0) if positive else np.abs(slack).max(initial=0.0)
    rr = t - 2 * b @ q + b @ g @ b
    s = l1 / top if top > l1 else 1.0
    ry = t - b @ q
    gap = 0.5 * rr * (1 + s * s) if s < 1 else rr
    return float(gap + l1 * np.abs(b).sum() - s * ry + 0.5 * l2 * (1 + s * s) * (b @ b))


class ElasticNet(LinearModel):
    """1/(2n) sum w r^2 + alpha * (l1_ratio |b|_1 + (1-l1_ratio)/2 |b|^2), weights scaled to sum to n."""

    def __init__(self, alpha=1.0, *, l1_ratio=0.5, fit_intercept=True, precompute=False, copy_X=True, max_iter=1000, tol=1e-4, warm_start=False, positive=False, random_state=None, selection="cyclic"):
        self.alpha, self.l1_ratio, self.fit_intercept, self.precompute, self.copy_X = alpha, l1_ratio, fit_intercept, precompute, copy_X
        self.max_iter, self.tol, self.warm_start, self.positive = max_iter, tol, warm_start, positive
        self.random_state, self.selection = random_state, selection

    def fit(self, df, features=None, label=None, weight=None):
        if self.alpha < 0 or not np.isfinite(self.alpha):
            raise ValueError("alpha must be a finite number, not negative")
        if not 0 <= self.l1_ratio <= 1:
            raise ValueError("l1_ratio must lie in [0, 1]")
        if self.selection != "cyclic":
            raise ValueError("only selection='cyclic' is supported")
        before = np.atleast_2d(self.coef_).copy() if self.warm_start and hasattr(self, "coef_") else None
        names, labels = self._start(df, features, label, weight)
        m = gram(df, names, labels, weight, self.fit_intercept)
        by = m.weight  # dividing by the weight sum is the rescaling to n, over n
        g, q, t = m.g / by, m.q / by, m.t / by
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        coef, its, gaps = np.zeros((len(names), len(labels))), [], []
        for k in range(len(labels)):
            start = before[k] if before is not None and before.shape == (len(labels), len(names)) else np.zeros(len(names))
            coef[:, k], it, done = descend(g, q[:, k], l1, l2, start, self.positive, self.max_iter, self.tol)
            its.append(it)
            gaps.append(dual_gap(g, q[:, k], t[k], coef[:, k], l1, l2, self.positive))
            if not done:
                warn(f"Objective did not converge in {self.max_iter} iterations", ConvergenceWarning)
        self.n_iter_ = max(its)
        self.dual_gap_ = gaps[0] if len(labels) == 1 else np.array(gaps)
        self._finish(coef, m.x_mean, m.y_mean)
        return self


class Lasso(ElasticNet):
    """Elastic net with l1_ratio 1."""

    def __init__(self, alpha=1.0, *, fit_intercept=True, precompute=False, copy_X=True, max_iter=1000, tol=1e-4, warm_start=False, positive=False, random_state=None, selection="cyclic"):
        super().__init__(alpha, l1_ratio=1.0, fit_intercept=fit_intercept, precompute=precompute, copy_X=copy_X, max_iter=max_iter, tol=tol, warm_start=warm_start, positive=positive, random_state=random_state, selection=selection)
