"""Exact nearest neighbours: blocked distances in Arrow batches against broadcast blocks of the training table.

The smaller of the two tables, queries or training rows, is sent to the executors in
numpy blocks of a counted size; the larger stays where it is and meets the blocks one
after the other in small tiles, keeping k candidates a query, so memory does not grow
with either. The k winners' distances are exact differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, infinite_count, is_number, kind_of, missing_count, names_or_all
from .base import BaseEstimator, ClassifierMixin, RegressorMixin, check_is_fitted
from .encode import discover_labels, lookup

#: Cells of a broadcast block of training rows, at most.
BLOCK_CELLS = 4_000_000
#: Queries and training rows of a tile of distances, and cells of the differences that are held at once.
QUERY_ROWS, TILE_ROWS, CELLS = 512, 2048, 1 << 17


def _rough(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a tile, squared for the euclidean one, with some rounding."""
    if metric == "euclidean":
        d2 = q @ t.T
        d2 *= -2
        d2 += (q * q).sum(1)[:, None]
        d2 += (t * t).sum(1)
        return np.maximum(d2, 0, out=d2)
    total, width = np.zeros((len(q), len(t))), max(1, CELLS // len(q))
    for i in range(0, len(t), width):
        part = total[:, i : i + width]
        gap = np.empty(part.shape)
        for a, b in zip(q.T, t[i : i + width].T, strict=True):
            np.subtract(a[:, None], b, out=gap)
            part += np.abs(gap, out=gap)
    return total


def nearest(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, metric: str, own: np.ndarray | None = None, best: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest rows of t for each row of q; ties go to the lower id; `own` ids are left out.

    best: what was found among other rows of the table, to go on from. Memory does not grow with t."""
    out_d, out_i = best or (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max))
    step, every = max(1, CELLS // max(1, q.shape[1])), np.arange(len(q))
    for start in range(0, len(t), TILE_ROWS):
        near, named = t[start : start + TILE_ROWS], ids[start : start + TILE_ROWS]
        rough = _rough(q, near, metric)
        if own is not None:
            rough[own[:, None] == named[None, :]] = np.inf
        m = min(len(near), k)
        # Rounding may blur the k-th place: everything within its error is scored exactly.
        cut = np.minimum(np.partition(rough, m - 1, axis=1)[:, m - 1], out_d[:, -1] ** (2 if metric == "euclidean" else 1))
        slack = 1e-9 * (1 + np.abs(cut) + ((q * q).sum(1) + (near * near).sum(1).max() if metric == "euclidean" else 0))
        row, at = np.nonzero(rough <= (cut + slack)[:, None])
        d = np.empty(len(row))
        for i in range(0, len(row), step):
            diff = near[at[i : i + step]] - q[row[i : i + step]]
            d[i : i + step] = np.sqrt((diff * diff).sum(1)) if metric == "euclidean" else np.abs(diff).sum(1)
        if own is not None:
            d[named[at] == own[row]] = np.inf
        row, d, i = np.concatenate((np.repeat(every, k), row)), np.concatenate((out_d.ravel(), d)), np.concatenate((out_i.ravel(), named[at]))
        order = np.lexsort((i, d, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], every)[row[order]]
        order = order[place < k]
        out_d, out_i = d[order].reshape(len(q), k), i[order].reshape(len(q), k)
    return out_d, out_i


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), int(sizes[0]))


def _rows(query: np.ndarray, near: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    k = near.shape[1]
    real = np.isfinite(distance.ravel())
    rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(query))
    columns = [np.repeat(query, k)[real], rank[real], near.ravel()[real], distance.ravel()[real]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["query", "rank", "neighbor", "distance"])


def _scan_queries(shared, k: int, metric: str, own: bool):
    """Batches of queries against a block of training rows."""

    def scan(batches):
        ids, t = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q_ids, q = b.column(0).to_numpy(), _matrix(b.column(1))
            for i in range(0, len(q), QUERY_ROWS):
                part = q_ids[i : i + QUERY_ROWS]
                d, n = nearest(q[i : i + QUERY_ROWS], t, ids, k, metric, part if own else None)
                yield _rows(part, n, d)

    return scan


def _scan_training(shared, k: int, metric: str):
    """A partition of training rows against a block of queries, keeping the k best of each."""

    def scan(batches):
        q_ids, q = shared.value
        best_d, best_n = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            ids, t = b.column(0).to_numpy(), _matrix(b.column(1))
            for i in range(0, len(q), QUERY_ROWS):
                at = slice(i, i + QUERY_ROWS)
                best_d[at], best_n[at] = nearest(q[at], t, ids, k, metric, best=(best_d[at], best_n[at]))
        yield _rows(q_ids, best_n, best_d)

    return scan


class _Neighbors(BaseEstimator):
    def __init__(self, n_neighbors=5, *, weights="uniform", algorithm="auto", leaf_size=30, p=2, metric="minkowski", metric_params=None, n_jobs=None):
        self.n_neighbors, self.weights, self.algorithm, self.leaf_size = n_neighbors, weights, algorithm, leaf_size
        self.p, self.metric, self.metric_params, self.n_jobs = p, metric, metric_params, n_jobs

    def _distance(self) -> str:
        if self.weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights {self.weights!r}")
        if self.algorithm not in ("auto", "brute"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.metric == "minkowski":
            if self.p not in (1, 2):
                raise ValueError("p must be 1 or 2")
            return "euclidean" if self.p == 2 else "manhattan"
        if self.metric not in ("euclidean", "manhattan"):
            raise ValueError(f"unknown metric {self.metric!r}")
        return self.metric

    def _vector(self, df: DataFrame, names: list[str]) -> Column:
        """One array column: the features side by side, or a single array column as it is."""
        if len(names) == 1 and isinstance(kind_of(df, names[0]), T.ArrayType):
            return c(names[0]).cast("array<double>")
        for n in names:
            if not is_number(kind_of(df, n)):
                raise ValueError(f"column {n!r} is not numeric")
        return F.array(*[c(n).cast("double") for n in names])

    def _check(self, df, names) -> int:
        """Rows of df; refuses missing and infinite values."""
        if isinstance(kind_of(df, names[0]), T.ArrayType):
            bad = F.count_if(c(names[0]).isNull() | F.exists(c(names[0]).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
        else:
            bad = infinite_count(df, names) + missing_count(df, names)
        row = df.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
        if row["bad"]:
            raise ValueError("Input contains NaN or infinity")
        return row["n"]

    def fit(self, df: DataFrame, features=None, label=None, id_col: str | None = None):
        """id_col is the row's number: it breaks ties and names neighbours."""
        if id_col is None:
            raise ValueError("id_col is required: rows have no order of their own")
        self._distance()
        if not isinstance(self.n_neighbors, int) or self.n_neighbors < 1:
            raise ValueError("n_neighbors must be an integer from 1")
        labels = [] if label is None else [label] if isinstance(label, str) else list(label)
        names = names_or_all(df, features, [*labels, id_col])
        self.n_samples_fit_ = self._check(df, names)
        self._record(names)
        self.id_, self.labels_, self.label_ = id_col, labels, labels[0] if labels else None
        self._train = df
        return self

    def _blocks(self, df: DataFrame, id_col: str):
        """A table in numpy blocks of bounded size, in id order."""
        data = df.select(c(id_col).cast("long").alias("id"), self._vector(df, self.feature_names_in_).alias("x"))
        first = data.first()
        rows = max(1, BLOCK_CELLS // max(1, len(first["x"]) if first else 1))
        ids, xs = [], []
        for row in data.orderBy("id").toLocalIterator(prefetchPartitions=True):
            ids.append(row["id"])
            xs.append(row["x"])
            if len(ids) == rows:
                yield np.array(ids, np.int64), np.array(xs, float)
                ids, xs = [], []
        if ids:
            yield np.array(ids, np.int64), np.array(xs, float)

    def kneighbors(self, df: DataFrame | None = None, n_neighbors: int | None = None, id_col: str | None = None) -> DataFrame:
        """(query, rank, neighbor, distance), ranks from 1. Without df the training rows are the queries, each leaving itself out."""
        check_is_fitted(self, "n_samples_fit_")
        k, metric, own = n_neighbors or self.n_neighbors, self._distance(), df is None
        if k > self.n_samples_fit_ - own:
            raise ValueError(f"Expected n_neighbors <= n_samples_fit, but n_neighbors = {k}, n_samples_fit = {self.n_samples_fit_ - own}")
        query = self._train if own else df
        id_col = self.id_ if own else (id_col or self.id_)
        n_query = self.n_samples_fit_
        if not own:
            self._require(df)
            n_query = self._check(df, self.feature_names_in_)
        # The smaller table goes to the executors in blocks; the larger stays where it is.
        sent, kept = ((query, id_col), (self._train, self.id_)) if n_query < self.n_samples_fit_ else ((self._train, self.id_), (query, id_col))
        spark, of_query = query.sparkSession, sent[0] is query and not own
        data = kept[0].select(c(kept[1]).cast("long").alias("id"), self._vector(kept[0], self.feature_names_in_).alias("x"))
        found, blocks = None, 0
        schema = "query long, rank int, neighbor long, distance double"
        for ids, x in self._blocks(*sent):
            shared, blocks = spark.sparkContext.broadcast((ids, x)), blocks + 1
            one = data.mapInArrow(_scan_training(shared, k, metric) if of_query else _scan_queries(shared, k, metric, own), schema)
            found = one if found is None else found.unionByName(one)
        if found is None:
            return spark.createDataFrame([], schema)
        if blocks == 1 and not of_query:
            return found
        # Several candidates lists a query: the best k of them.
        w = W.partitionBy("query").orderBy("distance", "neighbor")
        return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)

    def _weighted(self, df, id_col) -> DataFrame:
        """Neighbours with their weights; where one is at distance 0, only such ones count."""
        near = self.kneighbors(df, id_col=id_col)
        if self.weights == "uniform":
            return near.withColumn("w", F.lit(1.0))
        exact = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy("query"))
        near = near.withColumn("exact", exact)
        return near.withColumn("w", F.when(F.col("exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))).drop("exact")


class KNeighborsClassifier(ClassifierMixin, _Neighbors):
    def fit(self, df, features=None, label=None, id_col=None):
        super().fit(df, features, label, id_col)
        found = discover_labels(df, self.label_)
        if len(found.values) < 2:
            raise ValueError("at least two classes are required")
        self.classes_ = np.array(found.values, dtype=object)
        coded = lookup(df, self.label_, found.kind, found.index(), F.lit(None).cast("double"), "__code")
        self._codes = coded.select(c(id_col).cast("long").alias("neighbor"), F.col("__code").cast("int").alias("code"))
        return self

    def _votes(self, df, id_col) -> DataFrame:
        near = self._weighted(df, id_col).join(self._codes, "neighbor")
        return near.groupBy("query", "code").agg(F.sum("w").alias("vote"))

    def predict(self, df: DataFrame, id_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
        """df with `prediction`: the class with most votes, the lower one on ties."""
        id_col = id_col or self.id_
        votes = self._votes(df, id_col)
        best = votes.groupBy("query").agg(F.min_by("code", F.struct(-F.col("vote"), "code")).alias("code"))
        named = best.select(F.col("query").alias("__q"), F.get(F.array(*[F.lit(v) for v in self.classes_.tolist()]), F.col("code")).alias("prediction"))
        out = df.join(named, c(id_col).cast("long") == F.col("__q"), "left")
        return out.select(*map(c, df.columns if keep is None else keep), "prediction")

    def predict_proba(self, df: DataFrame, id_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
        id_col = id_col or self.id_
        votes = self._votes(df, id_col)
        total = F.sum("vote")
        shares = [(F.coalesce(F.sum(F.when(F.col("code") == i, F.col("vote"))), F.lit(0.0)) / total).alias(f"probability_{i}") for i in range(len(self.classes_))]
        named = votes.groupBy(F.col("query").alias("__q")).agg(*shares)
        out = df.join(named, c(id_col).cast("long") == F.col("__q"), "left")
        return out.select(*map(c, df.columns if keep is None else keep), *[f"probability_{i}" for i in range(len(self.classes_))])


class KNeighborsRegressor(RegressorMixin, _Neighbors):
    def predict(self, df: DataFrame, id_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
        """df with the (weighted) mean of the neighbours' targets."""
        id_col = id_col or self.id_
        targets = self._train.select(c(self.id_).cast("long").alias("neighbor"), *[c(y).cast("double").alias(f"__y{i}") for i, y in enumerate(self.labels_)])
        names = ["prediction"] if len(self.labels_) == 1 else [f"prediction_{i}" for i in range(len(self.labels_))]
        near = self._weighted(df, id_col).join(targets, "neighbor")
        means = [(F.sum(F.col("w") * F.col(f"__y{i}")) / F.sum("w")).alias(n) for i, n in enumerate(names)]
        named = near.groupBy(F.col("query").alias("__q")).agg(*means)
        out = df.join(named, c(id_col).cast("long") == F.col("__q"), "left")
        return out.select(*map(c, df.columns if keep is None else keep), *names)
