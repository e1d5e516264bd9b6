"""Checks of input tables: schema rules at once, data rules in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import c, infinite_count, is_number, kind_of, missing_count, names_or_all, number


def check_frame(df: DataFrame, features: list[str] | None = None, *, finite: bool | str = True, non_negative: bool = False, min_rows: int = 1, numeric: bool = True) -> list[str]:
    """The feature names, once the table passes: numeric columns, rows enough, values finite.

    finite: True refuses missing and infinite values, 'allow-nan' infinite ones only, False neither.
    """
    if finite not in (True, False, "allow-nan"):
        raise ValueError("finite must be True, False or 'allow-nan'")
    names = names_or_all(df, features)
    if numeric and (bad := [n for n in names if not is_number(kind_of(df, n))]):
        raise ValueError(f"columns are not numeric: {bad}")
    wanted = {"rows": F.count(F.lit(1))}
    if finite:
        wanted["infinite"] = infinite_count(df, names)
    if finite is True:
        wanted["missing"] = missing_count(df, names)
    if non_negative:
        wanted["negative"] = sum((F.count_if(number(df, n) < 0) for n in names), F.lit(0).cast("long"))
    found = df.agg(*[v.alias(k) for k, v in wanted.items()]).first().asDict()
    if found["rows"] < min_rows:
        raise ValueError(f"Found {found['rows']} rows while a minimum of {min_rows} is required")
    if found.get("infinite"):
        raise ValueError("Input contains infinity")
    if found.get("missing"):
        raise ValueError("Input contains NaN")
    if found.get("negative"):
        raise ValueError("Negative values in data")
    return names


def check_labelled(df: DataFrame, features: list[str] | None, label: str, **rules) -> tuple[list[str], str]:
    """As check_frame, and the label column exists and has no missing values."""
    if label not in df.columns:
        raise ValueError(f"no label column {label!r}")
    names = check_frame(df, [n for n in df.columns if n != label] if features is None else features, **rules)
    if df.agg(F.count_if(c(label).isNull())).first()[0]:
        raise ValueError("the label contains missing values")
    return names, label
