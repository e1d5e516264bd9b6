"""Ordinary least squares and ridge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import c
from ..base import BaseEstimator, RegressorMixin, check_is_fitted
from .gram import checked, gram, tall_qr

_EPS = np.finfo(np.float64).eps


class LinearModel(RegressorMixin, BaseEstimator):
    def _start(self, df, features, label, weight):
        names, labels = checked(df, features, label, weight)
        self._record(names)
        self.labels_, self.label_ = labels, labels[0]
        return names, labels

    def _finish(self, coef: np.ndarray, x_mean, y_mean) -> None:
        """coef: one column for each output."""
        b = y_mean - x_mean @ coef if self.fit_intercept else np.zeros(coef.shape[1])
        one = len(self.labels_) == 1
        self.coef_ = coef[:, 0] if one else coef.T
        self.intercept_ = (float(b[0]) if one else b) if self.fit_intercept else 0.0

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """df (or its columns `keep`) with `prediction`, or prediction_0, prediction_1, ... for several outputs."""
        check_is_fitted(self, "coef_")
        names = self._require(df)
        coef = np.atleast_2d(self.coef_)
        b = np.broadcast_to(self.intercept_, len(coef))
        out = []
        for k, row in enumerate(coef):
            total = F.lit(float(b[k]))
            for n, v in zip(names, row, strict=True):
                total = total + c(n).cast("double") * F.lit(float(v))
            out.append(total.alias("prediction" if len(coef) == 1 else f"prediction_{k}"))
        return df.select(*map(c, df.columns if keep is None else keep), *out)


class LinearRegression(LinearModel):
    """Weighted minimum-norm least squares: Gram eigen solve where that is accurate enough, else QR over all rows."""

    def __init__(self, *, fit_intercept=True, copy_X=True, tol=1e-6, n_jobs=None, positive=False):
        self.fit_intercept, self.copy_X, self.tol, self.n_jobs, self.positive = fit_intercept, copy_X, tol, n_jobs, positive

    def fit(self, df, features=None, label=None, weight=None):
        if self.positive:
            raise NotImplementedError("positive=True is not supported")
        names, labels = self._start(df, features, label, weight)
        m = gram(df, names, labels, weight, self.fit_intercept)
        coef = None
        if m.rows >= 4 * len(names):
            values, vectors = np.linalg.eigh(m.g)
            top = max(values[-1], 0.0)
            kept = values > self.tol**2 * top
            if kept.any():
                # The Gram squares the condition number: it is trusted only down to eps^(1/4).
                narrow = np.sqrt(values[kept].min() / top)
                if narrow >= _EPS**0.25 and (kept.all() or self.tol >= np.sqrt(_EPS)):
                    v = vectors[:, kept]
                    coef = v @ ((v.T @ m.q) / values[kept, None])
                    self.rank_ = int(kept.sum())
                    self.singular_ = np.sqrt(np.maximum(values, 0))[::-1]
        if coef is None:
            mean = np.concatenate([m.x_mean, m.y_mean])
            r, qty = tall_qr(df, names, labels, weight, mean)
            coef, _, self.rank_, self.singular_ = np.linalg.lstsq(r, qty, rcond=self.tol)
            self.rank_ = int(self.rank_)
        self._finish(coef, m.x_mean, m.y_mean)
        return self


class Ridge(LinearModel):
    """Least squares plus alpha * |b|^2; the intercept is free and alpha is not divided by the rows."""

    def __init__(self, alpha=1.0, *, fit_intercept=True, copy_X=True, max_iter=None, tol=1e-4, solver="auto", positive=False, random_state=None):
        self.alpha, self.fit_intercept, self.copy_X, self.max_iter, self.tol = alpha, fit_intercept, copy_X, max_iter, tol
        self.solver, self.positive, self.random_state = solver, positive, random_state

    def fit(self, df, features=None, label=None, weight=None):
        if self.positive:
            raise NotImplementedError("positive=True is not supported")
        if self.solver not in ("auto", "svd"):
            raise ValueError(f"unknown solver {self.solver!r}")
        if np.ndim(self.alpha) or self.alpha < 0 or not np.isfinite(self.alpha):
            raise ValueError("alpha must be a finite number, not negative")
        if self.alpha == 0:
            plain = LinearRegression(fit_intercept=self.fit_intercept).fit(df, features, label, weight)
            self.__dict__ |= {k: v for k, v in vars(plain).items() if k.endswith("_")}
            self.n_iter_ = [1] * len(self.labels_)
            return self
        names, labels = self._start(df, features, label, weight)
        m = gram(df, names, labels, weight, self.fit_intercept)
        a = m.g + self.alpha * np.eye(len(names))
        try:
            low = np.linalg.cholesky(a)
            coef = np.linalg.solve(low.T, np.linalg.solve(low, m.q))
        except np.linalg.LinAlgError:
            values, vectors = np.linalg.eigh(m.g)
            coef = vectors @ ((vectors.T @ m.q) / (np.maximum(values, 0) + self.alpha)[:, None])
        self.n_iter_ = [1] * len(labels)
        self._finish(coef, m.x_mean, m.y_mean)
        return self
