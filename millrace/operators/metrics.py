"""Metrics: one grouped or global aggregate, the rest on a table the size of the class list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, is_number, kind_of
from .base import UndefinedMetricWarning, warn


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else c(weight).cast("double")


def _weight_checks(weight: str | None) -> dict[str, Column]:
    if weight is None:
        return {}
    w = c(weight).cast("double")
    return {"bad_weight": F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == F.lit(float("inf"))) | (w < 0)), "weight_sum": F.sum(w)}


def _judge_weights(found, weight: str | None, zero=ValueError) -> None:
    if weight is not None:
        if found["bad_weight"]:
            raise ValueError("sample weights must be finite and not negative")
        if not found["weight_sum"]:
            raise zero("Weights sum to zero, can't be normalized")


def _listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _class_checks(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Continuous floats are no classes; types must agree."""
    kinds = {isinstance(kind_of(df, n), T.StringType) for n in names}
    if len(kinds) > 1:
        raise TypeError("labels mix strings and numbers")
    floats = [n for n in names if isinstance(kind_of(df, n), (T.FloatType, T.DoubleType))]
    total = F.lit(0).cast("long")
    for n in floats:
        total = total + F.count_if(F.isnan(c(n)) | (c(n) != F.floor(c(n))))
    return {"continuous": total}


def accuracy_score(df: DataFrame, y_true, y_pred, *, normalize: bool = True, weight: str | None = None) -> float:
    """Weighted share (or sum) of rows where all target columns agree."""
    t, p = _listed(y_true), _listed(y_pred)
    if len(t) != len(p):
        raise ValueError("y_true and y_pred have different widths")
    same = F.lit(True)
    for a, b in zip(t, p, strict=True):
        same = same & c(a).eqNullSafe(c(b))
    w = _weight(weight)
    wanted = {"hits": F.sum(F.when(same, w).otherwise(0.0)), "all": F.sum(w)} | _class_checks(df, t + p) | _weight_checks(weight)
    found = df.agg(*[v.alias(k) for k, v in wanted.items()]).first().asDict()
    if found["continuous"]:
        raise ValueError("continuous targets are not supported")
    _judge_weights(found, weight, ZeroDivisionError if normalize else ValueError)
    if found["all"] is None:
        return float("nan") if normalize else 0.0
    return found["hits"] / found["all"] if normalize else found["hits"]


def confusion_counts(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None) -> DataFrame:
    """(t, p, w): the one grouped aggregate all class metrics come from."""
    return df.groupBy(c(y_true).alias("t"), c(y_pred).alias("p")).agg(F.sum(_weight(weight)).alias("w"))


def _matrix(df, y_true, y_pred, labels, weight) -> tuple[list, np.ndarray]:
    checks = _class_checks(df, [y_true, y_pred]) | _weight_checks(weight)
    found = df.agg(*[v.alias(k) for k, v in checks.items()]).first().asDict()
    if found["continuous"]:
        raise ValueError("continuous targets are not supported")
    _judge_weights(found, weight)
    rows = confusion_counts(df, y_true, y_pred, weight).collect()
    if any(r["t"] is None or r["p"] is None for r in rows):
        raise ValueError("labels contain missing values")
    if labels is None:
        labels = sorted({r["t"] for r in rows} | {r["p"] for r in rows})
    elif not {r["t"] for r in rows} & set(labels):
        raise ValueError("At least one label specified must be in y_true")
    at = {v: i for i, v in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    for r in rows:  # rows with a side outside the labels are left out, on both sides
        if r["t"] in at and r["p"] in at:
            m[at[r["t"]], at[r["p"]]] += r["w"]
    return list(labels), m


def confusion_matrix(df, y_true: str, y_pred: str, *, labels=None, weight: str | None = None, normalize: str | None = None) -> np.ndarray:
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError("normalize must be one of {'true', 'pred', 'all', None}")
    labels, m = _matrix(df, y_true, y_pred, labels, weight)
    if len(labels) == 1:
        warn("A single label was found in y_true and y_pred")
    if normalize:
        total = {"true": m.sum(axis=1, keepdims=True), "pred": m.sum(axis=0, keepdims=True), "all": m.sum()}[normalize]
        with np.errstate(all="ignore"):
            return np.nan_to_num(m / total)
    return m.astype(np.int64) if weight is None else m


def _ratio(num: np.ndarray, den: np.ndarray, zero_division, what: str) -> np.ndarray:
    none = den == 0
    if none.any() and zero_division == "warn":
        warn(f"{what} is ill-defined and being set to 0.0", UndefinedMetricWarning)
    fill = 0.0 if zero_division == "warn" else float(zero_division)
    return np.where(none, fill, num / np.where(none, 1.0, den))


def _class_scores(what, df, y_true, y_pred, labels, pos_label, average, weight, zero_division):
    if average not in (None, "binary", "micro", "macro", "weighted"):
        raise ValueError(f"unknown average {average!r}")
    names, m = _matrix(df, y_true, y_pred, labels, weight)
    tp, pred, act = np.diag(m), m.sum(axis=0), m.sum(axis=1)
    if average == "binary":
        if len(names) > 2:
            raise ValueError("Target is multiclass but average='binary'")
        if pos_label not in names:
            raise ValueError(f"pos_label={pos_label!r} is not a valid label: {names}")
        one = [names.index(pos_label)]
        tp, pred, act = tp[one], pred[one], act[one]
    elif average == "micro":
        tp, pred, act = (x.sum(keepdims=True) for x in (tp, pred, act))
    num, den = {"Precision": (tp, pred), "Recall": (tp, act), "F-score": (2 * tp, act + pred)}[what]
    values = _ratio(num, den, zero_division, what)
    if average is None:
        return values
    if average in ("binary", "micro"):
        return float(values[0])
    if average == "weighted" and act.sum():
        used = ~np.isnan(values)
        return float(np.average(values[used], weights=act[used])) if act[used].sum() else float("nan")
    return float(np.nanmean(values)) if not np.isnan(values).all() else float("nan")


def precision_score(df, y_true, y_pred, *, labels=None, pos_label=1, average="binary", weight=None, zero_division="warn"):
    return _class_scores("Precision", df, y_true, y_pred, labels, pos_label, average, weight, zero_division)


def recall_score(df, y_true, y_pred, *, labels=None, pos_label=1, average="binary", weight=None, zero_division="warn"):
    return _class_scores("Recall", df, y_true, y_pred, labels, pos_label, average, weight, zero_division)


def f1_score(df, y_true, y_pred, *, labels=None, pos_label=1, average="binary", weight=None, zero_division="warn"):
    return _class_scores("F-score", df, y_true, y_pred, labels, pos_label, average, weight, zero_division)


def _errors(df, y_true, y_pred, weight, exprs) -> tuple[dict, int]:
    t, p = _listed(y_true), _listed(y_pred)
    if len(t) != len(p):
        raise ValueError("y_true and y_pred have different numbers of outputs")
    wanted = {"n": F.count(F.lit(1)), "w": F.sum(_weight(weight))} | _weight_checks(weight)
    bad = F.lit(0).cast("long")
    for n in t + p:
        if not is_number(kind_of(df, n)):
            raise ValueError(f"target {n!r} is not numeric")
        bad = bad + F.count_if(c(n).isNull() | F.isnan(c(n).cast("double")) | (F.abs(c(n).cast("double")) == F.lit(float("inf"))))
    wanted["bad"] = bad
    for i, (a, b) in enumerate(zip(t, p, strict=True)):
        y, d = c(a).cast("double"), c(a).cast("double") - c(b).cast("double")
        wanted |= {f"{k}{i}": v for k, v in exprs(_weight(weight), y, d).items()}
    found = df.agg(*[v.alias(k) for k, v in wanted.items()]).first().asDict()
    if found["bad"]:
        raise ValueError("Input contains missing values or infinity")
    if not found["n"]:
        raise ValueError("no samples")
    _judge_weights(found, weight)
    return found, len(t)


def _combine(values: np.ndarray, multioutput, variances: np.ndarray | None = None):
    if isinstance(multioutput, str):
        if multioutput == "raw_values":
            return values
        if multioutput == "uniform_average":
            return float(np.mean(values))
        if multioutput == "variance_weighted" and variances is not None:
            return float(np.average(values, weights=variances)) if variances.sum() else float(np.mean(values))
        raise ValueError(f"unknown multioutput {multioutput!r}")
    if len(multioutput) != len(values):
        raise ValueError("multioutput needs one weight for each output")
    return float(np.average(values, weights=multioutput))


def mean_squared_error(df, y_true, y_pred, *, weight=None, multioutput="uniform_average"):
    found, k = _errors(df, y_true, y_pred, weight, lambda w, y, d: {"s": F.sum(w * d * d)})
    return _combine(np.array([found[f"s{i}"] / found["w"] for i in range(k)]), multioutput)


def mean_absolute_error(df, y_true, y_pred, *, weight=None, multioutput="uniform_average"):
    found, k = _errors(df, y_true, y_pred, weight, lambda w, y, d: {"s": F.sum(w * F.abs(d))})
    return _combine(np.array([found[f"s{i}"] / found["w"] for i in range(k)]), multioutput)


def r2_score(df, y_true, y_pred, *, weight=None, multioutput="uniform_average", force_finite=True):
    """1 - residual / total sum of squares; constant targets give 1 if exact, else 0, unless force_finite is off."""
    first, k = _errors(df, y_true, y_pred, weight, lambda w, y, d: {"m": F.sum(w * y), "e": F.sum(w * d * d)})
    if first["n"] < 2:
        warn("R^2 score is not well-defined with less than two samples.", UndefinedMetricWarning)
        return float("nan")
    w = _weight(weight)
    means = [first[f"m{i}"] / first["w"] for i in range(k)]
    # A second pass around the mean avoids cancellation.
    row = df.agg(*[F.sum(w * (c(t).cast("double") - F.lit(m)) * (c(t).cast("double") - F.lit(m))) for t, m in zip(_listed(y_true), means, strict=True)]).first()
    e, total = np.array([first[f"e{i}"] for i in range(k)]), np.array(list(row), dtype=float)
    with np.errstate(all="ignore"):
        values = 1 - e / total
    if force_finite:
        values = np.where(total == 0, np.where(e == 0, 1.0, 0.0), values)
    return _combine(values, multioutput, total)
