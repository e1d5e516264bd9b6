"""Logistic regression: Spark ML's optimiser under this library's parameters, predictions as projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.columns import c, infinite_count, kind_of, missing_count, names_or_all
from ..base import BaseEstimator, ClassifierMixin, ConvergenceWarning, check_is_fitted, warn
from ..encode import discover_labels, lookup
from .gram import checked


class LogisticRegression(ClassifierMixin, BaseEstimator):
    """Weighted log loss / sum of weights + penalty; binary or softmax. coef_ has one row in the binary case."""

    def __init__(self, penalty="l2", *, dual=False, tol=1e-4, C=1.0, fit_intercept=True, intercept_scaling=1, class_weight=None, random_state=None, solver="lbfgs", max_iter=100, multi_class="auto", verbose=0, warm_start=False, n_jobs=None, l1_ratio=None):
        self.penalty, self.dual, self.tol, self.C, self.fit_intercept = penalty, dual, tol, C, fit_intercept
        self.intercept_scaling, self.class_weight, self.random_state, self.solver, self.max_iter = intercept_scaling, class_weight, random_state, solver, max_iter
        self.multi_class, self.verbose, self.warm_start, self.n_jobs, self.l1_ratio = multi_class, verbose, warm_start, n_jobs, l1_ratio

    def _mix(self) -> float:
        if self.penalty not in ("l2", "l1", "elasticnet", None):
            raise ValueError(f"unknown penalty {self.penalty!r}")
        if self.solver not in ("lbfgs", "rust", "saga"):
            raise ValueError(f"unknown solver {self.solver!r}")
        if self.solver == "lbfgs" and self.penalty in ("l1", "elasticnet"):
            raise ValueError("solver 'lbfgs' supports only 'l2' or None penalties")
        if not self.C > 0:
            raise ValueError("C must be positive")
        if self.penalty == "elasticnet":
            if self.l1_ratio is None or not 0 <= self.l1_ratio <= 1:
                raise ValueError("l1_ratio must lie in [0, 1] for penalty='elasticnet'")
            return float(self.l1_ratio)
        return 1.0 if self.penalty == "l1" else 0.0

    def fit(self, df: DataFrame, features=None, label=None, weight=None):
        from pyspark.ml.classification import LogisticRegression as MlLogistic
        from pyspark.ml.feature import VectorAssembler

        mix = self._mix()
        names = names_or_all(df, features, [label, *([weight] if weight else [])])
        checked(df, names, [], weight)
        if isinstance(kind_of(df, label), (T.FloatType, T.DoubleType)):
            if df.agg(F.count_if(F.isnan(c(label)) | (c(label) != F.floor(c(label))))).first()[0]:
                raise ValueError("Unknown label type: continuous")
        found = discover_labels(df, label)
        if len(found.values) < 2:
            raise ValueError("at least two classes are required")
        if len(found.values) > 2 and mix:
            raise ValueError("l1 and elasticnet penalties are for two classes only")
        w = F.lit(1.0) if weight is None else c(weight).cast("double")
        sums = df.agg((infinite_count(df, names) + missing_count(df, names)).alias("bad"), F.count_if(w.isNull() | F.isnan(w) | (w < 0)).alias("neg")).first()
        if sums["bad"]:
            raise ValueError("Input contains NaN or infinity")
        if sums["neg"]:
            raise ValueError("sample weights must be finite and not negative")
        if self.class_weight is not None:
            total, k = sum(found.counts), len(found.values)
            if self.class_weight == "balanced":
                by = {v: total / (k * n) for v, n in zip(found.values, found.counts, strict=True)}
            else:
                by = {v: float(self.class_weight.get(v, 1.0)) for v in found.values}
            factor = F.coalesce(*[F.when(c(label).eqNullSafe(F.lit(v)), F.lit(float(x))) for v, x in by.items()])
            w = w * factor
        coded = lookup(df, label, found.kind, found.index(), F.lit(None).cast("double"), "__code")
        data = coded.select("__code", w.alias("__weight"), *[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
        data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(data).select("__code", "__weight", "features")
        weight_sum = data.agg(F.sum("__weight")).first()[0]
        if not weight_sum:
            raise ValueError("sample weights must not all be zero")
        binary = len(found.values) == 2
        model = MlLogistic(
            featuresCol="features", labelCol="__code", weightCol="__weight", standardization=False, fitIntercept=self.fit_intercept,
            regParam=0.0 if self.penalty is None else 1.0 / (self.C * weight_sum), elasticNetParam=mix,
            family="binomial" if binary else "multinomial", maxIter=self.max_iter, tol=min(self.tol, 1e-6) * 1e-3,
        ).fit(data)
        self._record(names)
        self.label_, self.classes_ = label, np.array(found.values, dtype=object)
        self.coef_ = model.coefficientMatrix.toArray()
        self.intercept_ = model.interceptVector.toArray() if self.fit_intercept else np.zeros(len(self.coef_))
        self.n_iter_ = np.array([model.summary.totalIterations])
        if self.n_iter_[0] >= self.max_iter:
            warn(f"logistic regression did not converge in {self.max_iter} iterations", ConvergenceWarning)
        return self

    def _scores(self, df) -> list[Column]:
        check_is_fitted(self, "coef_")
        names = self._require(df)
        out = []
        for row, b in zip(self.coef_, self.intercept_, strict=True):
            total = F.lit(float(b))
            for n, v in zip(names, row, strict=True):
                total = total + c(n).cast("double") * F.lit(float(v))
            out.append(total)
        return out

    def _probabilities(self, df) -> list[Column]:
        s = self._scores(df)
        if len(s) == 1:
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-s[0]))
            return [F.lit(1.0) - p, p]
        top = F.greatest(*s)
        e = [F.exp(v - top) for v in s]
        total = e[0]
        for v in e[1:]:
            total = total + v
        return [v / total for v in e]

    def _with(self, df, keep, columns) -> DataFrame:
        return df.select(*map(c, df.columns if keep is None else keep), *columns)

    def decision_function(self, df, keep=None) -> DataFrame:
        s = self._scores(df)
        return self._with(df, keep, [v.alias("decision" if len(s) == 1 else f"decision_{i}") for i, v in enumerate(s)])

    def predict_proba(self, df, keep=None) -> DataFrame:
        return self._with(df, keep, [p.alias(f"probability_{i}") for i, p in enumerate(self._probabilities(df))])

    def predict_log_proba(self, df, keep=None) -> DataFrame:
        return self._with(df, keep, [F.log(p).alias(f"log_probability_{i}") for i, p in enumerate(self._probabilities(df))])

    def predict(self, df, keep=None) -> DataFrame:
        s = self._scores(df)
        labels = [F.lit(v) for v in self.classes_.tolist()]
        if len(s) == 1:
            best = F.when(s[0] > 0, labels[1]).otherwise(labels[0])
        else:
            top, best = F.greatest(*s), F.when(F.lit(False), labels[0])
            for v, label in zip(s, labels, strict=True):  # the first class that reaches the top
                best = best.when(v == top, label)
        return self._with(df, keep, [best.alias("prediction")])
