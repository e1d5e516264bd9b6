"""Centred weighted cross products, and tall-skinny QR for ill-conditioned inputs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import c, infinite_count, is_number, kind_of, missing_count, names_or_all

#: Columns up to which cross products are plain sums in generated code; wider ones are summed by numpy in batches.
SQL_COLUMNS = 24


@dataclass
class Gram:
    """g = sum w (x-mx)(x-mx)', q = sum w (x-mx)(y-my)', t = diag sum w (y-my)^2, and the means."""

    g: np.ndarray
    q: np.ndarray
    t: np.ndarray
    x_mean: np.ndarray
    y_mean: np.ndarray
    rows: int
    weight: float


def checked(df: DataFrame, features, labels, weight) -> tuple[list[str], list[str]]:
    labels = [labels] if isinstance(labels, str) else list(labels)
    names = names_or_all(df, features, [*labels, *([weight] if weight else [])])
    for n in names + labels:
        if not is_number(kind_of(df, n)):
            raise ValueError(f"column {n!r} is not numeric")
    return names, labels


def gram(df: DataFrame, names: list[str], labels: list[str], weight: str | None, intercept: bool) -> Gram:
    """Two passes: sums for the means (and the checks), then products around the means."""
    every = names + labels
    w = F.lit(1.0) if weight is None else c(weight).cast("double")
    x = [c(n).cast("double") for n in every]
    first = {"n": F.count(F.lit(1)), "bad": infinite_count(df, every) + missing_count(df, every), "w": F.sum(w), "neg": F.count_if(w.isNull() | F.isnan(w) | (w < 0) | (w == F.lit(float("inf"))))}
    first |= {f"s{i}": F.sum(w * v) for i, v in enumerate(x)}
    row = df.agg(*[v.alias(k) for k, v in first.items()]).first()
    if not row["n"]:
        raise ValueError("no samples")
    if row["bad"]:
        raise ValueError("Input contains NaN or infinity")
    if row["neg"] or not row["w"]:
        raise ValueError("sample weights must be finite, not negative, and not all zero")
    mean = np.array([row[f"s{i}"] / row["w"] for i in range(len(every))]) if intercept else np.zeros(len(every))
    d = [v - F.lit(float(m)) if intercept else v for v, m in zip(x, mean, strict=True)]
    p, k = len(names), len(every)
    if k <= SQL_COLUMNS:
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        sums = df.agg(*[F.sum(w * d[i] * d[j]).alias(f"c{n}") for n, (i, j) in enumerate(cells)]).first()
        m = np.zeros((k, k))
        for n, (i, j) in enumerate(cells):
            m[i, j] = m[j, i] = sums[n]
    else:
        m = _products(df.select(w.alias("w"), *[v.alias(f"x{i}") for i, v in enumerate(x)]), mean)
    return Gram(m[:p, :p], m[:p, p:], np.diag(m)[p:].copy(), mean[:p], mean[p:], int(row["n"]), float(row["w"]))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns]).astype(float)


def _products(df: DataFrame, mean: np.ndarray) -> np.ndarray:
    k = len(mean)

    def scan(batches):
        total = np.zeros((k, k))
        for b in batches:
            z = _matrix(b)
            x = z[:, 1:] - mean
            total += (x * z[:, :1]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["cell", "v"])

    rows = df.mapInArrow(scan, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * k)
    for r in rows:
        out[r["cell"]] = r["v"]
    return out.reshape(k, k)


def tall_qr(df: DataFrame, names, labels, weight, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, Q'Y) of the centred, weighted columns: each task reduces its rows to one triangle, few tasks reduce those."""
    w = F.lit(1.0) if weight is None else c(weight).cast("double")
    every = names + labels
    k = len(every)
    data = df.select(w.alias("w"), *[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(every)])

    def reduce_rows(batches, centre):
        r = np.zeros((0, k))
        for b in batches:
            z = _matrix(b)
            x = (z[:, 1:] - mean) * np.sqrt(z[:, :1]) if centre else z
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r[:, i]) for i in range(k)], names=[f"x{i}" for i in range(k)])

    schema = ", ".join(f"x{i} double" for i in range(k))
    part = data.mapInArrow(lambda b: reduce_rows(b, True), schema)
    few = part.repartition(32).mapInArrow(lambda b: reduce_rows(b, False), schema)
    rows = np.array([list(r) for r in few.collect()])
    r = np.linalg.qr(rows, mode="r")
    r = np.vstack([r, np.zeros((max(0, k - len(r)), k))])
    p = len(names)
    # The label columns beside R carry Q'Y; what lies below R is residual.
    return r[:p, :p], r[:p, p:]
