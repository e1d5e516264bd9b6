"""Scalers: every fit is one aggregate row, every transform a projection with literals."""

from __future__ import annotations

import statistics

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, in_kind, infinite_count, kind_of, literal, missing_count, names_or_all, number, replaced
from ..plans.fuse import Percentiles, fit_together
from .base import BaseEstimator, OneToOneMixin

_EPS = float(np.finfo(np.float64).eps)
_EPS32 = float(np.finfo(np.float32).eps)


def _refuse_infinite(found: dict) -> None:
    if found["infinite"]:
        raise ValueError("Input contains infinity")


def _array(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=np.float64)


class _Scaler(OneToOneMixin, BaseEstimator):
    """fit_exprs and fit_from_row make the fit; _forward and _backward give the projections."""

    def fit(self, df: DataFrame, features: list[str] | None = None):
        for name in [a for a in vars(self) if a.endswith("_")]:
            delattr(self, name)
        names = names_or_all(df, features)
        fit_together(df, [(self, names)])
        return self

    def _project(self, df: DataFrame, one) -> DataFrame:
        names = self._require(df)
        return replaced(df, {n: in_kind(df, n, one(i, number(df, n))) for i, n in enumerate(names)})

    def transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, self._forward)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, self._backward)


class StandardScaler(_Scaler):
    """(x - mean) / scale with population variance; scale is 1 where the variance is exactly 0."""

    def __init__(self, *, with_mean: bool = True, with_std: bool = True):
        self.with_mean, self.with_std = with_mean, with_std

    def fit_exprs(self, df, features) -> dict[str, Column]:
        out = {"infinite": infinite_count(df, features)}
        for i, n in enumerate(features):
            x = number(df, n)
            out |= {f"n{i}": F.count(x), f"m{i}": F.avg(x), f"v{i}": F.var_pop(x)}
        return out

    def fit_from_row(self, df, features, found) -> None:
        _refuse_infinite(found)
        self._record(features)
        k = range(len(features))
        self._set(np.array([found[f"n{i}"] for i in k], dtype=np.int64), _array(found[f"m{i}"] for i in k), _array(found[f"v{i}"] for i in k))

    def _set(self, count, mean, var) -> None:
        self._count, self._mean, self._var = count, mean, var
        self.mean_ = mean if self.with_mean or self.with_std else None
        self.var_ = var if self.with_std else None
        self.scale_ = np.where(var == 0, 1.0, np.sqrt(var)) if self.with_std else None
        self.n_samples_seen_ = int(count[0]) if len(set(count.tolist())) == 1 else count

    def partial_fit(self, df: DataFrame, features: list[str] | None = None):
        """Adds a batch: counts, means and variances of both parts are merged. A column missing so far takes the batch's."""
        if not hasattr(self, "features_"):
            return self.fit(df, features)
        new = StandardScaler(with_mean=self.with_mean, with_std=self.with_std).fit(df, self.features_)
        return self.merge(new)

    def merge(self, other: StandardScaler):
        na, nb = self._count.astype(float), other._count.astype(float)
        n = np.maximum(na + nb, 1)
        ma, mb, va, vb = (np.where(w > 0, x, 0.0) for w, x in ((na, self._mean), (nb, other._mean), (na, self._var), (nb, other._var)))
        mean = ma + (mb - ma) * nb / n
        var = (va * na + vb * nb + (mb - ma) ** 2 * na * nb / n) / n
        none = na + nb == 0
        self._set(self._count + other._count, np.where(none, np.nan, mean), np.where(none, np.nan, var))
        return self

    def _forward(self, i, x):
        if self.with_mean:
            x = x - literal(self.mean_[i])
        return x / literal(self.scale_[i]) if self.with_std else x

    def _backward(self, i, x):
        if self.with_std:
            x = x * literal(self.scale_[i])
        return x + literal(self.mean_[i]) if self.with_mean else x


class MinMaxScaler(_Scaler):
    """Maps [min, max] of each column to feature_range; a constant column has range 1."""

    def __init__(self, feature_range=(0, 1), *, clip: bool = False, strict: bool = False):
        self.feature_range, self.clip, self.strict = feature_range, clip, strict

    def fit_exprs(self, df, features):
        if not self.feature_range[0] < self.feature_range[1]:
            raise ValueError("feature_range must rise")
        out = {"infinite": infinite_count(df, features), "rows": F.count(F.lit(1))}
        for i, n in enumerate(features):
            x = number(df, n)
            out |= {f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
        return out

    def fit_from_row(self, df, features, found):
        _refuse_infinite(found)
        self._record(features)
        k = range(len(features))
        self._set(_array(found[f"lo{i}"] for i in k), _array(found[f"hi{i}"] for i in k), found["rows"])

    def _set(self, low, high, rows) -> None:
        lo, hi = self.feature_range
        self.data_min_, self.data_max_, self.data_range_, self.n_samples_seen_ = low, high, high - low, int(rows)
        self.scale_ = (hi - lo) / np.where(self.data_range_ == 0, 1.0, self.data_range_)
        self.min_ = lo - low * self.scale_

    def partial_fit(self, df, features=None):
        """Adds a batch. With strict=True a column that is wholly missing in any batch stays missing."""
        if not hasattr(self, "features_"):
            return self.fit(df, features)
        return self.merge(MinMaxScaler(self.feature_range).fit(df, self.features_))

    def merge(self, other: MinMaxScaler):
        low, high = (np.minimum, np.maximum) if self.strict else (np.fmin, np.fmax)
        self._set(low(self.data_min_, other.data_min_), high(self.data_max_, other.data_max_), self.n_samples_seen_ + other.n_samples_seen_)
        return self

    def _forward(self, i, x):
        y = x * literal(self.scale_[i]) + literal(self.min_[i])
        if self.clip:
            lo, hi = self.feature_range
            y = F.when(y.isNotNull(), F.least(F.greatest(y, F.lit(float(lo))), F.lit(float(hi))))
        return y

    def _backward(self, i, x):
        return (x - literal(self.min_[i])) / literal(self.scale_[i])


class MaxAbsScaler(_Scaler):
    """x / max(abs(x)); a column of zeros, or without values, has scale 1."""

    def __init__(self):
        pass

    def fit_exprs(self, df, features):
        out = {"infinite": infinite_count(df, features), "rows": F.count(F.lit(1))}
        return out | {f"m{i}": F.max(F.abs(number(df, n))) for i, n in enumerate(features)}

    def fit_from_row(self, df, features, found):
        _refuse_infinite(found)
        self._record(features)
        self._set(np.nan_to_num(_array(found[f"m{i}"] for i in range(len(features)))), found["rows"])

    def _set(self, peak, rows) -> None:
        self.max_abs_, self.n_samples_seen_ = peak, int(rows)
        self.scale_ = np.where(peak == 0, 1.0, peak)

    def partial_fit(self, df, features=None):
        if not hasattr(self, "features_"):
            return self.fit(df, features)
        return self.merge(MaxAbsScaler().fit(df, self.features_))

    def merge(self, other: MaxAbsScaler):
        self._set(np.fmax(self.max_abs_, other.max_abs_), self.n_samples_seen_ + other.n_samples_seen_)
        return self

    def _forward(self, i, x):
        return x / literal(self.scale_[i])

    def _backward(self, i, x):
        return x * literal(self.scale_[i])


class RobustScaler(_Scaler):
    """(x - median) / (upper - lower percentile), exact and linearly interpolated; `approx` uses a bounded sketch."""

    def __init__(self, *, with_centering=True, with_scaling=True, quantile_range=(25.0, 75.0), copy=True, unit_variance=False, approx=False):
        self.with_centering, self.with_scaling, self.quantile_range = with_centering, with_scaling, quantile_range
        self.copy, self.unit_variance, self.approx = copy, unit_variance, approx

    def fit_exprs(self, df, features):
        low, high = self.quantile_range
        if not 0 <= low <= high <= 100:
            raise ValueError(f"Invalid quantile range: {self.quantile_range}")
        q = [low / 100, 0.5, high / 100]
        out = {"infinite": infinite_count(df, features)}
        for i, n in enumerate(features):
            x = number(df, n)
            out[f"q{i}"] = F.percentile_approx(x, q, 1_000_000) if self.approx else Percentiles(x, q)
        return out

    def fit_from_row(self, df, features, found):
        _refuse_infinite(found)
        self._record(features)
        q = np.array([found[f"q{i}"] or [np.nan] * 3 for i in range(len(features))], dtype=np.float64)
        self.center_ = q[:, 1] if self.with_centering else None
        self.scale_ = None
        if self.with_scaling:
            scale = q[:, 2] - q[:, 0]
            scale = np.where(scale < 10 * _EPS, 1.0, scale)
            if self.unit_variance:
                with np.errstate(divide="ignore"):
                    scale = scale / (_normal_quantile(self.quantile_range[1]) - _normal_quantile(self.quantile_range[0]))
            self.scale_ = scale

    def _forward(self, i, x):
        if self.with_centering:
            x = x - literal(self.center_[i])
        if self.with_scaling:
            s = self.scale_[i]
            x = F.when(x.isNull(), None).when(x == 0, float("nan")).otherwise(F.signum(x) * float("inf")) if s == 0 else x / literal(s)
        return x

    def _backward(self, i, x):
        if self.with_scaling:
            x = x * literal(self.scale_[i])
        return x + literal(self.center_[i]) if self.with_centering else x


def _normal_quantile(percent: float) -> np.float64:
    if percent in (0, 100):
        return np.float64(-np.inf if percent == 0 else np.inf)
    return np.float64(statistics.NormalDist().inv_cdf(percent / 100))


class Normalizer(OneToOneMixin, BaseEstimator):
    """Scales each row to unit norm (l1, l2 or max); rows of a tiny norm stay as they are."""

    def __init__(self, norm: str = "l2", *, copy: bool = True):
        self.norm, self.copy = norm, copy

    def fit(self, df, features=None):
        names = names_or_all(df, features)
        if self.norm not in ("l1", "l2", "max"):
            raise ValueError(f"unknown norm {self.norm!r}")
        bad = df.agg((infinite_count(df, names) + missing_count(df, names)).alias("bad")).first()["bad"]
        if bad:
            raise ValueError("Input contains NaN or infinity")
        self._record(names)
        return self

    def transform(self, df):
        names = self._require(df)
        x = [number(df, n) for n in names]
        if self.norm == "l2":
            total = x[0] * x[0]
            for v in x[1:]:
                total = total + v * v
            size = F.sqrt(total)
        elif self.norm == "l1":
            size = F.abs(x[0])
            for v in x[1:]:
                size = size + F.abs(v)
        else:
            size = F.greatest(*[F.abs(v) for v in x]) if len(x) > 1 else F.abs(x[0])
        all_float = all(kind_of(df, n).simpleString() == "float" for n in names)
        by = F.when(size < 10 * (_EPS32 if all_float else _EPS), F.lit(1.0)).otherwise(size)
        return replaced(df, {n: in_kind(df, n, v / by) for n, v in zip(names, x, strict=True)})


def normalize_array(column: str, norm: str = "l2") -> Column:
    """Unit norm for an array column, element by element."""
    x = F.transform(c(column), lambda v: v.cast("double"))
    zero = F.lit(0.0)
    if norm == "l2":
        size = F.sqrt(F.aggregate(x, zero, lambda a, v: a + v * v))
    elif norm == "l1":
        size = F.aggregate(x, zero, lambda a, v: a + F.abs(v))
    elif norm == "max":
        size = F.aggregate(x, zero, lambda a, v: F.greatest(a, F.abs(v)))
    else:
        raise ValueError(f"unknown norm {norm!r}")
    by = F.when(size < 10 * _EPS, F.lit(1.0)).otherwise(size)
    return F.transform(x, lambda v: v / by)


