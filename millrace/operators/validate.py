"""Cross-validation over fold columns, and named scorers."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from . import metrics
from .base import FitFailedWarning, clone, warn
from .split import BaseCrossValidator, KFold, StratifiedKFold


def _of(metric, sign: float = 1.0, **options) -> Callable:
    def scorer(estimator, df, label):
        labels = [label] if isinstance(label, str) else list(label)
        guesses = ["prediction"] if len(labels) == 1 else [f"prediction_{i}" for i in range(len(labels))]
        scored = estimator.predict(df, keep=labels)
        return sign * metric(scored, labels if len(labels) > 1 else labels[0], guesses if len(labels) > 1 else guesses[0], **options)

    return scorer


SCORERS = {
    "accuracy": _of(metrics.accuracy_score),
    "precision": _of(metrics.precision_score),
    "precision_macro": _of(metrics.precision_score, average="macro"),
    "recall": _of(metrics.recall_score),
    "recall_macro": _of(metrics.recall_score, average="macro"),
    "f1": _of(metrics.f1_score),
    "f1_macro": _of(metrics.f1_score, average="macro"),
    "neg_mean_squared_error": _of(metrics.mean_squared_error, -1.0),
    "neg_mean_absolute_error": _of(metrics.mean_absolute_error, -1.0),
    "r2": _of(metrics.r2_score),
}


def check_scoring(scoring) -> Callable:
    if scoring is None:
        return lambda estimator, df, label: estimator.score(df, label)
    if callable(scoring):
        return scoring
    if scoring not in SCORERS:
        raise ValueError(f"{scoring!r} is not a valid scoring value")
    return SCORERS[scoring]


def _is_classifier(estimator) -> bool:
    return getattr(getattr(estimator, "_final_estimator", estimator), "_estimator_type", None) == "classifier"


def _folds(estimator, df, order_by, label, cv):
    if cv is None or isinstance(cv, int):
        cv = (StratifiedKFold if _is_classifier(estimator) else KFold)(5 if cv is None else cv)
    if isinstance(cv, BaseCrossValidator):
        folded = cv.assign(df, order_by, label if isinstance(label, str) else None).cache()
        try:
            for i in range(cv.get_n_splits()):
                yield folded.filter(folded["fold"] != i).drop("fold"), folded.filter(folded["fold"] == i).drop("fold")
        finally:
            folded.unpersist()
    else:
        yield from cv


def cross_val_score(estimator, df: DataFrame, features=None, label=None, *, order_by, groups=None, scoring=None, cv=None, n_jobs=None, verbose=0, params=None, error_score=float("nan")) -> np.ndarray:
    """A score for each fold; a failing fold gets error_score and a warning, unless all fail or error_score is 'raise'."""
    if groups is not None:
        raise NotImplementedError("groups are not supported")
    scorer, scores, failed = check_scoring(scoring), [], 0
    for train, test in _folds(estimator, df, order_by, label, cv):
        began = time.time()
        try:
            fitted = clone(estimator)
            fitted.fit(train, features=features, label=label, **(params or {}))
            score = float(scorer(fitted, test, label))
        except Exception as e:
            if error_score == "raise":
                raise
            failed += 1
            score = float(error_score)
            warnings.warn(f"a fold failed: {type(e).__name__}: {e}", FitFailedWarning, stacklevel=2)
        scores.append(score)
        if verbose:
            warn(f"fold {len(scores)}: {score:.4f} in {time.time() - began:.1f} s")
    if scores and failed == len(scores):
        raise ValueError("all folds failed")
    return np.array(scores)
