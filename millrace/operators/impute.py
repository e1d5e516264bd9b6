"""SimpleImputer: one statistic for each column, then coalesce."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, in_kind, is_number, kind_of, names_or_all
from ..plans.fuse import Percentiles, fit_together
from .base import BaseEstimator, TransformerMixin, check_is_fitted, warn


def _is_nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


class SimpleImputer(TransformerMixin, BaseEstimator):
    """Replaces missing values by a column statistic.

    strategy: mean, median (exact), most_frequent (smallest on ties), constant, or a
    callable from a Column of the values (NULL where missing) to an aggregate Column.
    missing_values: NaN or None match NULL and NaN; another value matches itself.
    """

    def __init__(self, *, missing_values=float("nan"), strategy="mean", fill_value=None, copy=True, add_indicator=False, keep_empty_features=False):
        self.missing_values, self.strategy, self.fill_value = missing_values, strategy, fill_value
        self.copy, self.add_indicator, self.keep_empty_features = copy, add_indicator, keep_empty_features

    def _any_missing(self) -> bool:
        return self.missing_values is None or _is_nan(self.missing_values)

    def _gone(self, df: DataFrame, name: str) -> Column:
        """Whether a value is missing; never NULL."""
        x, kind = c(name), kind_of(df, name)
        nan = F.isnan(x) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False)
        if self._any_missing():
            return x.isNull() | F.coalesce(nan, F.lit(False))
        if is_number(kind) != (isinstance(self.missing_values, (int, float)) and not isinstance(self.missing_values, bool)):
            return F.lit(False)
        return x.eqNullSafe(F.lit(self.missing_values))

    def _value(self, df: DataFrame, name: str) -> Column:
        x = c(name).cast("double") if is_number(kind_of(df, name)) else c(name)
        return F.when(~self._gone(df, name), x)

    def fit_exprs(self, df, features):
        numeric = [n for n in features if is_number(kind_of(df, n))]
        if self.strategy not in ("mean", "median", "most_frequent", "constant") and not callable(self.strategy):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.strategy in ("mean", "median") and len(numeric) < len(features):
            raise ValueError(f"strategy {self.strategy!r} needs numeric columns")
        out = {}
        for i, n in enumerate(features):
            v, kind = self._value(df, n), kind_of(df, n)
            out |= {f"n{i}": F.count(v), f"gone{i}": F.count_if(self._gone(df, n))}
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                out[f"inf{i}"] = F.count_if(F.abs(v) == F.lit(float("inf")))
                if not self._any_missing():
                    out[f"nan{i}"] = F.count_if(F.isnan(v) | c(n).isNull())
            if self.strategy == "mean":
                out[f"s{i}"] = F.avg(v)
            elif self.strategy == "median":
                out[f"s{i}"] = Percentiles(v, [0.5])
            elif self.strategy == "most_frequent":
                out[f"s{i}"] = F.mode(v, True)
            elif callable(self.strategy):
                out[f"s{i}"] = self.strategy(v)
        return out

    def fit_from_row(self, df, features, found):
        for i, n in enumerate(features):
            if found.get(f"inf{i}"):
                raise ValueError(f"Input contains infinity in {n!r}")
            if found.get(f"nan{i}"):
                raise ValueError(f"Input contains NaN in {n!r}")
        self.features_ = self.feature_names_in_ = list(features)
        self.n_features_in_ = len(features)
        stats, kept = [], []
        for i, n in enumerate(features):
            numeric, empty = is_number(kind_of(df, n)), not found[f"n{i}"]
            default = 0.0 if numeric else "missing_value"
            if self.strategy == "constant":
                value = default if self.fill_value is None else self.fill_value
                empty = empty and not self.keep_empty_features
            else:
                value = found[f"s{i}"]
                if self.strategy == "median" and value is not None:
                    value = value[0]
            if empty:
                value = (default if self.fill_value is None or self.strategy != "constant" else self.fill_value) if self.keep_empty_features else None
            if value is None:
                warn(f"Skipping features without any observed values: [{n!r}]. At least one non-missing value is needed for imputation with strategy={self.strategy!r}.")
            else:
                kept.append(n)
            stats.append(value)
        self.kept_ = kept
        self.statistics_ = np.array([np.nan if v is None else v for v in stats], dtype=object if any(isinstance(v, str) for v in stats) else None)
        self._fill = dict(zip(features, stats, strict=True))
        self.indicated_ = [n for i, n in enumerate(features) if found[f"gone{i}"]] if self.add_indicator else []

    def fit(self, df: DataFrame, features: list[str] | None = None):
        fit_together(df, [(self, names_or_all(df, features))])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Columns without values at fit are dropped; indicator columns come last."""
        check_is_fitted(self)
        out = []
        for n in df.columns:
            if n not in self.features_:
                out.append(c(n))
            elif n in self.kept_:
                fill = F.lit(float(self._fill[n]) if is_number(kind_of(df, n)) else self._fill[n])
                v = F.coalesce(self._value(df, n), fill)
                out.append((in_kind(df, n, v) if is_number(kind_of(df, n)) else v).alias(n))
        out += [self._gone(df, n).cast("double").alias(f"missingindicator_{n}") for n in self.indicated_]
        return df.select(*out)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Puts the sentinel back where an indicator is set; dropped columns return filled with it."""
        if not self.add_indicator:
            raise ValueError("inverse_transform needs add_indicator=True")
        marks = {f"missingindicator_{n}" for n in self.indicated_}
        sentinel = F.lit(None) if self._any_missing() else F.lit(self.missing_values)
        out = [c(n) for n in df.columns if n not in marks and n not in self.features_]
        for n in self.features_:
            if n not in self.kept_:
                out.append((sentinel.cast("double") if self._any_missing() else sentinel).alias(n))
            elif n in self.indicated_:
                out.append(F.when(c(f"missingindicator_{n}") == 1, sentinel).otherwise(c(n)).alias(n))
            else:
                out.append(c(n))
        return df.select(*out)

    def get_feature_names_out(self, input_features=None) -> list[str]:
        check_is_fitted(self)
        return [*self.kept_, *(f"missingindicator_{n}" for n in self.indicated_)]
