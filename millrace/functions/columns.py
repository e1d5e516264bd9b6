"""Column expressions: the missing-value rule, finiteness checks, literals.

NULL is the one missing value. NaN in a numeric input becomes NULL at the boundary, so
that built-in aggregates skip it; infinity is refused where a fit reads the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def number(df: DataFrame, name: str) -> Column:
    """The column as double, NaN as NULL."""
    kind = kind_of(df, name)
    if isinstance(kind, T.BooleanType):
        return c(name).cast("int").cast("double")
    if not is_number(kind):
        raise ValueError(f"column {name!r} is not numeric: {kind.simpleString()}")
    x = c(name).cast("double")
    return F.when(F.isnan(x), None).otherwise(x) if isinstance(kind, (T.FloatType, T.DoubleType)) else x


def missing(df: DataFrame, name: str) -> Column:
    x = c(name)
    return x.isNull() | F.isnan(x) if isinstance(kind_of(df, name), (T.FloatType, T.DoubleType)) else x.isNull()


def infinite_count(df: DataFrame, names: Sequence[str]) -> Column:
    """How many values are infinite: one more aggregate of the same pass."""
    tests = [F.count_if(F.abs(c(n)) == F.lit(float("inf"))) for n in names if isinstance(kind_of(df, n), (T.FloatType, T.DoubleType))]
    total = F.lit(0).cast("long")
    for t in tests:
        total = total + t
    return total


def missing_count(df: DataFrame, names: Sequence[str]) -> Column:
    total = F.lit(0).cast("long")
    for n in names:
        total = total + F.count_if(missing(df, n))
    return total


def literal(value: float | None) -> Column:
    """A double literal; None and NaN are NULL."""
    return F.lit(None).cast("double") if value is None or math.isnan(value) else F.lit(float(value))


def in_kind(df: DataFrame, name: str, value: Column) -> Column:
    """Double results, or float where the input column is float."""
    return value.cast("float") if isinstance(kind_of(df, name), T.FloatType) else value


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with some columns replaced in place, in one projection."""
    own = [new[n].alias(n) if n in new else c(n) for n in df.columns]
    return df.select(*own, *[v.alias(n) for n, v in new.items() if n not in df.columns])


def names_or_all(df: DataFrame, features: Sequence[str] | None, label: Sequence[str] = ()) -> list[str]:
    names = [n for n in df.columns if n not in label] if features is None else list(features)
    if not names:
        raise ValueError("at least one feature column is required")
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return names
