"""One aggregate job for the fits of several estimators over one input, and exact percentiles in a few more."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates in one job, at most: wider ones fall out of generated code.
WIDEST = 200
#: Bins that a range of values is counted in, and columns whose ranges share a job.
BINS, COLUMNS = 4096, 32


@dataclass(frozen=True)
class Percentiles:
    """Stands among fit_exprs for exact percentiles (shares from 0 to 1), linearly interpolated, of a double column.

    Found are their values, or None where the column has none, or has infinity or NaN.
    """

    x: Column
    shares: list[float]

    def first(self) -> list[Column]:
        return [F.count(self.x), F.min(self.x), F.max(self.x)]


@dataclass(frozen=True)
class _Range:
    """The n values of a column from low to high, which are among them, and how many lie before."""

    column: int
    low: float
    high: float
    before: int
    n: int

    def at(self, rank: int) -> float | None:
        """The value at a rank in the column, if the range tells it."""
        if self.low == self.high or rank == self.before:
            return self.low
        return self.high if rank == self.before + self.n - 1 else None

    def bin(self, x: Column) -> Column:
        """A number that never falls as x rises, and differs at both ends: by sign, by magnitude over wide ranges, else even."""
        low, high = self.low, self.high
        if low <= 0 <= high:
            return F.signum(x).cast("int")
        if max(low / high, high / low) > 2:
            a, b = math.log(abs(low)), math.log(abs(high))
            place = (F.log(F.abs(x)) - F.lit(a)) / F.lit(b - a)
        else:
            place = (x - F.lit(low)) / F.lit(high - low)
        return F.floor(place * BINS).cast("int")


def _narrowed(df: DataFrame, columns: list[Column], ranges: list[_Range]) -> dict[_Range, list[_Range]]:
    """Each range's parts, in order: one for each of its bins that has values. Columns without a range are not read."""
    places = {}
    for k, r in enumerate(ranges):
        x = columns[r.column]
        here = F.struct(F.lit(k).alias("k"), r.bin(x).alias("bin"), x.alias("x"))
        places[r.column] = F.when(x.between(r.low, r.high), here).otherwise(places.get(r.column, F.lit(None)))
    each = list(places.values())
    rows = df.select((F.explode(F.array(*each)) if len(each) > 1 else each[0]).alias("v")).filter("v is not null")
    counted = rows.groupBy("v.k", "v.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v.x").alias("low"), F.max("v.x").alias("high"))
    out = {r: [] for r in ranges}
    for row in sorted(counted.collect(), key=lambda row: (row["k"], row["bin"])):
        r = ranges[row["k"]]
        before = out[r][-1].before + out[r][-1].n if out[r] else r.before
        out[r].append(_Range(r.column, row["low"] + 0.0, row["high"] + 0.0, before, row["n"]))
    return out


def percentiles(df: DataFrame, wanted: list[Percentiles], first: list[tuple]) -> list[list[float] | None]:
    """The values of `wanted`, from the count, least and largest value of each column.

    A percentile lies between the values at two ranks. Each pass over the input counts the
    ranges that hold an unknown rank in bins, and goes on with the bins that hold it. So
    no task holds, sends or reads more than some BINS rows for each range and task before,
    however many rows and values there are. Seven passes tell any doubles apart;
    amounts of money take two or three.
    """
    need, held = {}, {}
    for i, (p, (n, low, high)) in enumerate(zip(wanted, first, strict=True)):
        if n and math.isfinite(low) and math.isfinite(high):
            need[i] = [(n - 1) * share for share in p.shares]
            whole = _Range(i, low + 0.0, high + 0.0, 0, n)
            held |= {(i, rank): whole for at in need[i] for rank in (math.floor(at), math.ceil(at))}
    while unknown := {key: r for key, r in held.items() if r.at(key[1]) is None}:
        some = sorted({i for i, _ in unknown})[:COLUMNS]
        parts = _narrowed(df, [p.x for p in wanted], sorted({r for r in unknown.values() if r.column in some}, key=lambda r: (r.column, r.before)))
        for (i, rank), r in unknown.items():
            if r in parts:
                k = int(np.searchsorted([x.before for x in parts[r]], rank, side="right")) - 1
                if k < 0 or sum(x.n for x in parts[r]) != r.n:
                    raise RuntimeError("the rows of the input differ from one pass to the next")
                held[i, rank] = parts[r][k]
    out = []
    for i in range(len(wanted)):
        if i not in need:
            out.append(None)
            continue
        values = []
        for at in need[i]:
            lower, upper = math.floor(at), math.ceil(at)
            a, b = held[i, lower].at(lower), held[i, upper].at(upper)
            values.append(a if a == b else (upper - at) * a + (at - lower) * b)
        out.append(values)
    return out


def fit_together(df: DataFrame, fits: list[tuple[object, list[str]]]) -> None:
    """Fits estimators that state their aggregates (fit_exprs) and take the results (fit_from_row)."""
    wanted, later = {}, {}
    for k, (estimator, features) in enumerate(fits):
        for name, expr in estimator.fit_exprs(df, features).items():
            key = f"{k}:{name}"
            if isinstance(expr, Percentiles):
                later[key] = expr
                wanted |= {f"{key} {j}": e for j, e in enumerate(expr.first())}
            else:
                wanted[key] = expr
    names, found = list(wanted), {}
    for i in range(0, len(names), WIDEST):
        some = names[i : i + WIDEST]
        row = df.agg(*[wanted[n].alias(f"a{j}") for j, n in enumerate(some)]).first()
        found |= {n: row[j] for j, n in enumerate(some)}
    if later:
        found |= zip(later, percentiles(df, list(later.values()), [tuple(found.pop(f"{key} {j}") for j in range(3)) for key in later]), strict=True)
    for k, (estimator, features) in enumerate(fits):
        mine = {n.split(":", 1)[1]: v for n, v in found.items() if n.startswith(f"{k}:")}
        estimator.fit_from_row(df, features, mine)


def fusible(estimator) -> bool:
    return hasattr(estimator, "fit_exprs") and getattr(estimator, "fusible_", lambda: True)()
