"""Label, ordinal and one-hot encoding over per-column dictionaries.

Dictionaries come from one grouped count over all columns. Small ones become map
literals in the plan; larger ones a broadcast join of a counted size, and beyond that
an ordinary join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, is_number, kind_of, names_or_all, replaced
from .base import BaseEstimator, TransformerMixin, check_is_fitted, warn

#: Dictionaries up to this size are map literals; up to the next, broadcast.
MAP_ENTRIES, BROADCAST_ENTRIES = 1_000, 1_000_000
#: The name of grouped rare categories, as users of the estimators know it.
INFREQUENT = "infrequent_sklearn"


def _class_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "string"
    raise TypeError(f"unsupported type: {kind.simpleString()}")


def _key(kind: str, value) -> tuple:
    """Sort key: numbers ascending with missing last, strings by code point with missing last."""
    gone = value is None or (isinstance(value, float) and math.isnan(value))
    return (gone, 0 if gone else value)


@dataclass
class Dictionary:
    """Categories of one column in code order, and how often each occurred."""

    name: str
    kind: str
    values: list
    counts: list[int] = field(default_factory=list)

    def index(self) -> dict:
        return {v: i for i, v in enumerate(self.values)}


def _normal(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL and -0.0 as 0.0."""
    x = c(name)
    if isinstance(kind_of(df, name), (T.FloatType, T.DoubleType)):
        x = F.when(F.isnan(x), None).otherwise(x.cast("double") + F.lit(0.0))
    return x


def discover(df: DataFrame, names: list[str]) -> list[Dictionary]:
    """The dictionary of each column, from one shuffle of (column, value) counts."""
    kinds = {n: _class_of(kind_of(df, n)) for n in names}
    as_text = F.array(*[F.struct(F.lit(i).alias("i"), _normal(df, n).cast("string").alias("v")) for i, n in enumerate(names)])
    rows = df.select(F.explode(as_text).alias("x")).groupBy("x.i", "x.v").count().collect()
    read = {"bool": lambda s: s == "true", "int": int, "float": float, "string": str, "decimal": int}
    out = []
    for i, n in enumerate(names):
        found = [(None if r["v"] is None else read[kinds[n]](r["v"]), r["count"]) for r in rows if r["i"] == i]
        if kinds[n] == "float" and any(v is not None and math.isinf(v) for v, _ in found):
            raise ValueError("Input contains infinity")
        found.sort(key=lambda p: _key(kinds[n], p[0]))
        out.append(Dictionary(n, kinds[n], [v for v, _ in found], [k for _, k in found]))
    return out


def stated(df: DataFrame, names: list[str], categories: list) -> list[Dictionary]:
    """Dictionaries from given categories: numbers unique and ascending, strings in the given order."""
    if len(categories) != len(names):
        raise ValueError("Shape mismatch: categories must give one list for each feature")
    seen = {d.name: d for d in discover(df, names)}
    out = []
    for n, given in zip(names, categories, strict=True):
        values = [None if v is None or (isinstance(v, float) and math.isnan(v)) else v.item() if isinstance(v, np.generic) else v for v in given]
        kind = _class_of(kind_of(df, n))
        if not values:
            raise ValueError(f"categories of {n!r} are empty")
        if len(set(values)) < len(values):
            raise ValueError(f"categories of {n!r} are not unique")
        if kind != "string" and [_key(kind, v) for v in values] != sorted(_key(kind, v) for v in values):
            raise ValueError(f"Unsorted categories are not supported for numerical categories: {n!r}")
        counts = dict(zip(seen[n].values, seen[n].counts, strict=True))
        unknown = [v for v in counts if v not in set(values)]
        if unknown:
            raise ValueError(f"Found unknown category {unknown} in {n!r} during fit")
        out.append(Dictionary(n, kind, values, [counts.get(v, 0) for v in values]))
    return out


def infrequent(counts: list[int], rows: int, min_frequency, max_categories) -> list[int]:
    """Indices of categories that are grouped: too rare, then the rarest (lowest index first) beyond the limit."""
    rare = set()
    if min_frequency is not None:
        bound = min_frequency if isinstance(min_frequency, int) else min_frequency * rows
        rare = {i for i, k in enumerate(counts) if k < bound}
    if max_categories is not None:
        room = max_categories - 1
        often = [i for i in range(len(counts)) if i not in rare]
        if len(often) > room and (len(counts) > room):
            ranked = sorted(often, key=lambda i: (counts[i], i))
            rare |= set(ranked[: len(often) - room])
    return sorted(rare)


def _literal(kind: str, v) -> Column:
    return F.lit(None) if v is None else F.lit(v)


def lookup(df: DataFrame, name: str, kind: str, table: dict, default: Column, out: str) -> DataFrame:
    """df with column `out`: table[value] (doubles), or default for values the table lacks."""
    x = _normal(df, name)
    if kind != "string" and _class_of(kind_of(df, name)) == "string" or kind == "string" and _class_of(kind_of(df, name)) != "string":
        raise TypeError(f"column {name!r} has another type than at fit")
    of_null = F.lit(float(table[None])) if None in table else default
    known = {k: v for k, v in table.items() if k is not None}
    if len(known) <= MAP_ENTRIES:
        if not known:
            code = F.lit(None).cast("double")
        else:
            as_kind = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "decimal": "decimal(20,0)"}[kind]
            pairs = [p for k, v in known.items() for p in (F.lit(k).cast(as_kind), F.lit(float(v)))]
            code = F.try_element_at(F.create_map(*pairs), x.cast(as_kind))
        return df.withColumn(out, F.when(x.isNull(), of_null).otherwise(F.coalesce(code, default)))
    spark = df.sparkSession
    as_kind = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "decimal": T.DecimalType(20, 0)}[kind]
    schema = T.StructType([T.StructField("__mr_key", as_kind), T.StructField("__mr_code", T.DoubleType())])
    small = spark.createDataFrame([(k, float(v)) for k, v in known.items()], schema)
    small = F.broadcast(small) if len(known) <= BROADCAST_ENTRIES else small
    joined = df.withColumn("__mr_value", x.cast(as_kind)).join(small, F.col("__mr_value") == F.col("__mr_key"), "left")
    code = F.when(F.col("__mr_value").isNull(), of_null).otherwise(F.coalesce("__mr_code", default))
    return joined.withColumn(out, code).drop("__mr_value", "__mr_key", "__mr_code")


def encode_categories(df: DataFrame, dictionaries: list[Dictionary]) -> DataFrame:
    """Codes in place of values; -1 for values outside the dictionary."""
    kept = df.columns
    for d in dictionaries:
        df = lookup(df, d.name, d.kind, d.index(), F.lit(-1.0), "__mr_code_out")
        df = df.withColumn(d.name, F.col("__mr_code_out").cast("bigint")).drop("__mr_code_out")
    return df.select(*[c(n) for n in kept])


def _refuse(message: Column) -> Column:
    return F.raise_error(message).cast("double")


class LabelEncoder(BaseEstimator):
    """Codes 0..k-1 of the sorted classes of one column. Unknown labels raise when the plan runs."""

    def __init__(self):
        pass

    def fit(self, df: DataFrame, label: str):
        found = discover_labels(df, label)
        self.label_, self.kind_, self.classes_ = label, found.kind, np.array(found.values, dtype=object)
        self._table = found.index()
        return self

    def transform(self, df: DataFrame, label: str | None = None) -> DataFrame:
        check_is_fitted(self)
        label = label or self.label_
        if _class_of(kind_of(df, label)) != self.kind_:
            raise TypeError(f"labels of kind {self.kind_} were fitted, {_class_of(kind_of(df, label))} are given")
        kept = df.columns
        unknown = _refuse(F.concat(F.lit("unknown label: "), F.coalesce(c(label).cast("string"), F.lit("NULL"))))
        out = lookup(df, label, self.kind_, self._table, unknown, "__mr_code_out")
        return replaced(out, {label: F.col("__mr_code_out").cast("bigint")}).select(*[c(n) for n in kept])

    def fit_transform(self, df, label):
        return self.fit(df, label).transform(df)

    def inverse_transform(self, df: DataFrame, label: str | None = None) -> DataFrame:
        check_is_fitted(self)
        label = label or self.label_
        if not isinstance(kind_of(df, label), T.IntegralType):
            raise TypeError("encoded labels must be integers")
        k = len(self.classes_)
        bad = F.raise_error(F.concat(F.lit("encoded label "), c(label).cast("string"), F.lit(" is outside the valid range")))
        inside = (c(label) >= 0) & (c(label) < k)
        values = F.array(*[F.lit(v) for v in self.classes_.tolist()]) if k else F.array(F.lit(None))
        return replaced(df, {label: F.when(inside, F.get(values, c(label).cast("int"))).otherwise(bad.cast(_spark_kind(self.kind_)))})


def discover_labels(df: DataFrame, label: str) -> Dictionary:
    """As discover, but infinity is a label like any other."""
    kind = _class_of(kind_of(df, label))
    rows = df.groupBy(_normal(df, label).alias("v")).count().collect()
    pairs = sorted(((r["v"], r["count"]) for r in rows), key=lambda p: _key(kind, p[0]))
    if kind == "decimal":
        pairs = [(None if v is None else int(v), k) for v, k in pairs]
    return Dictionary(label, kind, [v for v, _ in pairs], [k for _, k in pairs])


def _spark_kind(kind: str) -> str:
    return {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "decimal": "decimal(20,0)"}[kind]


class _CategoryEncoder(TransformerMixin, BaseEstimator):
    def _discover(self, df, features) -> None:
        names = names_or_all(df, features)
        self._check()
        auto = isinstance(self.categories, str) and self.categories == "auto"
        self.dictionaries_ = discover(df, names) if auto else stated(df, names, self.categories)
        self._record(names)
        self.categories_ = [np.array(d.values, dtype=object) for d in self.dictionaries_]
        self._rare = [
            infrequent(d.counts, sum(d.counts), self.min_frequency, self.max_categories)
            if self.min_frequency is not None or self.max_categories is not None
            else []
            for d in self._groupable()
        ]

    def _check(self) -> None:
        m, k = self.min_frequency, self.max_categories
        if m is not None and (isinstance(m, bool) or not (isinstance(m, int) and m >= 1 or isinstance(m, float) and 0 < m < 1)):
            raise ValueError("min_frequency must be an integer from 1 or a float in (0, 1)")
        if k is not None and (isinstance(k, bool) or not isinstance(k, int) or k < 1):
            raise ValueError("max_categories must be an integer from 1")

    @property
    def infrequent_categories_(self) -> list:
        check_is_fitted(self)
        return [np.array([d.values[i] for i in rare], dtype=object) if rare else None for d, rare in zip(self._groupable(), self._rare, strict=True)]


class OrdinalEncoder(_CategoryEncoder):
    """Codes by category rank; rare categories share the code after the frequent ones."""

    def __init__(self, *, categories="auto", dtype="double", handle_unknown="error", unknown_value=None, encoded_missing_value=float("nan"), min_frequency=None, max_categories=None):
        self.categories, self.dtype, self.handle_unknown, self.unknown_value = categories, dtype, handle_unknown, unknown_value
        self.encoded_missing_value, self.min_frequency, self.max_categories = encoded_missing_value, min_frequency, max_categories

    def _check(self):
        super()._check()
        if self.handle_unknown not in ("error", "use_encoded_value"):
            raise ValueError("handle_unknown must be 'error' or 'use_encoded_value'")
        nan = isinstance(self.unknown_value, float) and math.isnan(self.unknown_value)
        if self.handle_unknown == "use_encoded_value":
            if not (nan or isinstance(self.unknown_value, int)):
                raise TypeError("unknown_value should be an integer or NaN")
            if nan and self.dtype not in ("double", "float"):
                raise ValueError("a NaN unknown_value needs a float dtype")
        elif self.unknown_value is not None:
            raise TypeError("unknown_value is for handle_unknown='use_encoded_value' only")

    def _groupable(self) -> list[Dictionary]:
        """Missing values have their own code and are not grouped."""
        return [
            Dictionary(d.name, d.kind, [v for v in d.values if v is not None], [k for v, k in zip(d.values, d.counts, strict=True) if v is not None])
            for d in self.dictionaries_
        ]

    def fit(self, df, features=None):
        self._discover(df, features)
        self._tables = []
        for d, rare in zip(self._groupable(), self._rare, strict=True):
            often = [i for i in range(len(d.values)) if i not in set(rare)]
            code = {i: j for j, i in enumerate(often)} | {i: len(often) for i in rare}
            self._tables.append({d.values[i]: j for i, j in code.items()})
            used = set(code.values())
            if self.handle_unknown == "use_encoded_value" and self.unknown_value in used:
                raise ValueError(f"unknown_value {self.unknown_value} is already used for encoding the seen categories")
            if self.encoded_missing_value in used and None in self.dictionaries_[len(self._tables) - 1].values:
                raise ValueError(f"encoded_missing_value {self.encoded_missing_value} is already used for encoding the seen categories")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Missing and NaN sentinels come out as NULL where they are NaN."""
        self._require(df)
        kept = df.columns
        for d, table in zip(self.dictionaries_, self._tables, strict=True):
            if self.handle_unknown == "error":
                other = _refuse(F.concat(F.lit(f"Found unknown category in column {d.name}: "), F.coalesce(c(d.name).cast("string"), F.lit("NULL"))))
            else:
                other = _number(self.unknown_value)
            seen = None in d.values
            gone = _number(self.encoded_missing_value) if seen else other
            whole = lookup(df, d.name, d.kind, table, other, "__mr_code_out")
            code = F.when(_normal(df, d.name).isNull(), gone).otherwise(F.col("__mr_code_out"))
            df = whole.withColumn(d.name, code.cast(self.dtype)).drop("__mr_code_out")
        return df.select(*[c(n) for n in kept])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = self._require(df)
        out = {}
        for n, d, g, rare in zip(names, self.dictionaries_, self._groupable(), self._rare, strict=True):
            x = c(n).cast("double")
            x = F.when(F.isnan(x), None).otherwise(x)
            values = [v for i, v in enumerate(g.values) if i not in set(rare)]
            kind = "string" if rare else _spark_kind(d.kind)
            table = [F.lit(v).cast(kind) for v in values] + ([F.lit(INFREQUENT)] if rare else [])
            whole = (x == F.floor(x)) & (x >= 0) & (x < len(table))
            bad = F.raise_error(F.concat(F.lit(f"invalid code in {n}: "), x.cast("string"))).cast(kind)
            value = F.when(whole, F.get(F.array(*table), x.cast("int"))).otherwise(bad)
            for sentinel, valid in ((self.unknown_value, self.handle_unknown == "use_encoded_value"), (self.encoded_missing_value, None in d.values)):
                if valid:
                    is_it = x.isNull() if isinstance(sentinel, float) and math.isnan(sentinel) else x == float(sentinel)
                    value = F.when(is_it, F.lit(None).cast(kind)).otherwise(value)
            out[n] = value
        return replaced(df, out)

    def get_feature_names_out(self, input_features=None):
        check_is_fitted(self)
        return list(self.feature_names_in_)


def _number(v) -> Column:
    return F.lit(None).cast("double") if v is None or (isinstance(v, float) and math.isnan(v)) else F.lit(float(v))


class OneHotEncoder(_CategoryEncoder):
    """0/1 columns, one for each kept category. sparse_output=True gives coordinates by `to_coo`; transform is wide."""

    def __init__(self, *, categories="auto", drop=None, sparse_output=True, dtype="double", handle_unknown="error", min_frequency=None, max_categories=None, feature_name_combiner="concat"):
        self.categories, self.drop, self.sparse_output, self.dtype, self.handle_unknown = categories, drop, sparse_output, dtype, handle_unknown
        self.min_frequency, self.max_categories, self.feature_name_combiner = min_frequency, max_categories, feature_name_combiner

    def _check(self):
        super()._check()
        if self.handle_unknown not in ("error", "ignore", "infrequent_if_exist", "warn"):
            raise ValueError(f"unknown handle_unknown {self.handle_unknown!r}")

    def _groupable(self):
        return self.dictionaries_

    def fit(self, df, features=None):
        self._discover(df, features)
        self._codes, self._labels, drops = [], [], []
        for d, rare in zip(self.dictionaries_, self._rare, strict=True):
            often = [i for i in range(len(d.values)) if i not in set(rare)]
            code = {i: j for j, i in enumerate(often)} | {i: len(often) for i in rare}
            self._codes.append({d.values[i]: j for i, j in code.items()})
            self._labels.append([d.values[i] for i in often] + ([INFREQUENT] if rare else []))
        for j, (d, labels) in enumerate(zip(self.dictionaries_, self._labels, strict=True)):
            if self.drop is None or isinstance(self.drop, str) and self.drop == "if_binary" and len(labels) != 2:
                drops.append(None)
            elif isinstance(self.drop, str):
                if self.drop not in ("first", "if_binary"):
                    raise ValueError(f"unknown drop {self.drop!r}")
                drops.append(0)
            else:
                if len(self.drop) != len(self.dictionaries_):
                    raise ValueError("`drop` should have one value for each feature")
                value = self.drop[j]
                value = None if isinstance(value, float) and math.isnan(value) else value
                if value not in self._codes[j]:
                    raise ValueError(f"The following categories were supposed to be dropped, but were not found: {value!r}")
                drops.append(self._codes[j][value])
        self._drop = drops
        self.drop_idx_ = None if self.drop is None else np.array([None if k is None else self._first(j, k) for j, k in enumerate(drops)], dtype=object)
        return self

    def _first(self, j: int, code: int) -> int:
        """Index of the first original category with that code."""
        return next(i for i, v in enumerate(self.dictionaries_[j].values) if self._codes[j][v] == code)

    def _has_rare(self, j: int) -> bool:
        return bool(self._rare[j])

    def _other(self, j: int) -> Column:
        n = self.dictionaries_[j].name
        if self.handle_unknown == "error":
            return _refuse(F.concat(F.lit(f"Found unknown categories in column {n} during transform: "), F.coalesce(c(n).cast("string"), F.lit("NULL"))))
        if self.handle_unknown in ("infrequent_if_exist", "warn") and self._has_rare(j):
            return F.lit(float(len(self._labels[j]) - 1))
        return F.lit(-1.0)

    def _coded(self, df: DataFrame) -> DataFrame:
        self._require(df)
        if self.handle_unknown == "ignore" and self.drop is not None:
            warn("unknown categories will be encoded as all zeros, like dropped ones")
        for j, d in enumerate(self.dictionaries_):
            df = lookup(df, d.name, d.kind, self._codes[j], self._other(j), f"__mr_code_{j}")
        return df

    def _kept(self, j: int) -> list[int]:
        return [k for k in range(len(self._labels[j])) if k != self._drop[j]]

    def transform(self, df: DataFrame) -> DataFrame:
        """The other columns, then the 0/1 columns in feature order."""
        others = [c(n) for n in df.columns if n not in self.feature_names_in_]
        names, made = iter(self.get_feature_names_out()), []
        coded = self._coded(df)
        for j in range(len(self.dictionaries_)):
            made += [F.when(F.col(f"__mr_code_{j}") == k, 1.0).otherwise(0.0).cast(self.dtype).alias(next(names)) for k in self._kept(j)]
        return coded.select(*others, *made)

    def to_coo(self, df: DataFrame, row: str) -> DataFrame:
        """(row, col, value): the non-zero cells, for encodings too wide for columns."""
        coded, at, cells = self._coded(df), 0, []
        for j in range(len(self.dictionaries_)):
            kept = self._kept(j)
            d = self._drop[j]
            code = F.col(f"__mr_code_{j}")
            place = code if d is None else F.when(code == d, -1.0).when(code > d, code - 1).otherwise(code)
            cells.append(F.when(place >= 0, (place + at).cast("bigint")))
            at += len(kept)
        return coded.select(c(row).alias("row"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("col"), F.lit(1.0).alias("value"))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        check_is_fitted(self)
        names, out, used = iter(self.get_feature_names_out()), [], set()
        for j, d in enumerate(self.dictionaries_):
            kind = "string" if self._has_rare(j) else _spark_kind(d.kind)
            kept = [(k, next(names)) for k in self._kept(j)]
            used |= {n for _, n in kept}
            active = F.lit(0.0)
            for _, n in kept:
                active = active + c(n).cast("double")
            zero = F.lit(None).cast(kind)
            if self._drop[j] is not None:
                zero = F.lit(self._labels[j][self._drop[j]]).cast(kind)
            elif self.handle_unknown == "error":
                zero = F.raise_error(F.lit(f"Samples can not be inverted: {d.name} is all zeros")).cast(kind)
            value = F.when(active > 1, F.raise_error(F.lit(f"more than one active column for {d.name}")).cast(kind))
            for k, n in kept:
                value = value.when(c(n) == 1, F.lit(self._labels[j][k]).cast(kind))
            out.append(value.otherwise(zero).alias(d.name))
        return df.select(*[c(n) for n in df.columns if n not in used], *out)

    def get_feature_names_out(self, input_features=None):
        check_is_fitted(self)
        join = (lambda f, v: f"{f}_{v}") if self.feature_name_combiner == "concat" else self.feature_name_combiner
        shown = lambda v: "nan" if v is None and not isinstance(v, str) else v
        out = [join(d.name, shown(self._labels[j][k])) for j, d in enumerate(self.dictionaries_) for k in self._kept(j)]
        if len(set(out)) < len(out):
            raise ValueError("feature names are not unique")
        return out
