"""Sparse matrices as coordinates: a table (row, col, value) and a shape; cells that are not listed are zero."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scale tables up to so many columns are map literals; wider ones are joined.
MAP_COLUMNS = 1_000


def canonical(coo: DataFrame) -> DataFrame:
    """Duplicate cells summed."""
    return coo.groupBy("row", "col").agg(F.sum("value").alias("value"))


def validate(coo: DataFrame, shape: tuple[int, int]) -> None:
    n, m = shape
    r, k, v = F.col("row"), F.col("col"), F.col("value").cast("double")
    found = coo.agg(
        F.count_if(r.isNull() | (r < 0) | (r >= n)).alias("rows"),
        F.count_if(k.isNull() | (k < 0) | (k >= m)).alias("cols"),
        F.count_if(F.abs(v) == F.lit(float("inf"))).alias("infinite"),
    ).first()
    if found["rows"] or found["cols"]:
        raise ValueError("sparse index is out of bounds")
    if found["infinite"]:
        raise ValueError("Input contains infinity")


def standard_stats(coo: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, variance) of each column; implicit zeros count, missing values do not."""
    n, m = shape
    v = F.col("value").cast("double")
    gone = v.isNull() | F.isnan(v)
    ok = F.when(~gone, v)
    rows = coo.groupBy("col").agg(F.count_if(gone).alias("gone"), F.coalesce(F.sum(ok), F.lit(0.0)).alias("s"), F.coalesce(F.sum(ok * ok), F.lit(0.0)).alias("q")).collect()
    gone_, s, q = np.zeros(m), np.zeros(m), np.zeros(m)
    for r in rows:
        gone_[r["col"]], s[r["col"]], q[r["col"]] = r["gone"], r["s"], r["q"]
    count = n - gone_
    with np.errstate(all="ignore"):
        mean = s / count
        var = q / count - mean**2
    var = np.where((var < 0) & (var > -1e-12), 0.0, var)
    return count.astype(np.int64), mean, var


def max_abs(coo: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    v = F.col("value").cast("double")
    out = np.zeros(shape[1])
    for r in coo.groupBy("col").agg(F.max(F.abs(F.when(~F.isnan(v), v))).alias("m")).collect():
        out[r["col"]] = r["m"] or 0.0
    return out


def scale_columns(coo: DataFrame, scale: np.ndarray, inverse: bool = False) -> DataFrame:
    """Values divided (inverse: multiplied) by their column's scale; structure stays."""
    if len(scale) <= MAP_COLUMNS:
        by = F.get(F.array(*[F.lit(float(s)) for s in scale]), F.col("col").cast("int"))
        return coo.withColumn("value", F.col("value") * by if inverse else F.col("value") / by)
    table = coo.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(scale)], "col long, __by double")
    joined = coo.join(table, "col")
    return joined.select("row", "col", (F.col("value") * F.col("__by") if inverse else F.col("value") / F.col("__by")).alias("value"))


class SparseStandardScaler:
    """StandardScaler over coordinates: no centring."""

    def __init__(self, *, with_mean: bool = False, with_std: bool = True):
        if with_mean:
            raise ValueError("Cannot center sparse matrices: pass `with_mean=False` instead.")
        self.with_std = with_std

    def fit(self, coo: DataFrame, shape: tuple[int, int]):
        coo = canonical(coo)
        validate(coo, shape)
        self.count_, mean, var = standard_stats(coo, shape)
        self.mean_ = mean if self.with_std else None
        self.var_ = var if self.with_std else None
        self.scale_ = np.where(var == 0, 1.0, np.sqrt(var)) if self.with_std else None
        self.n_samples_seen_ = int(self.count_[0]) if len(set(self.count_.tolist())) == 1 else self.count_
        return self

    def transform(self, coo: DataFrame) -> DataFrame:
        return scale_columns(canonical(coo), self.scale_) if self.with_std else canonical(coo)

    def inverse_transform(self, coo: DataFrame) -> DataFrame:
        return scale_columns(canonical(coo), self.scale_, inverse=True) if self.with_std else canonical(coo)


class SparseMaxAbsScaler:
    """MaxAbsScaler over coordinates."""

    def fit(self, coo: DataFrame, shape: tuple[int, int]):
        coo = canonical(coo)
        validate(coo, shape)
        self.max_abs_, self.n_samples_seen_ = max_abs(coo, shape), shape[0]
        self.scale_ = np.where(self.max_abs_ == 0, 1.0, self.max_abs_)
        return self

    def transform(self, coo: DataFrame) -> DataFrame:
        return scale_columns(canonical(coo), self.scale_)

    def inverse_transform(self, coo: DataFrame) -> DataFrame:
        return scale_columns(canonical(coo), self.scale_, inverse=True)
