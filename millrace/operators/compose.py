"""Pipelines and column-wise composition of lazy DataFrame transforms."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..plans.fuse import fit_together, fusible
from .base import BaseEstimator, check_is_fitted, clone


def _auto_names(estimators) -> list[str]:
    base = [e if isinstance(e, str) else type(e).__name__.lower() for e in estimators]
    count, seen, out = Counter(base), Counter(), []
    for b in base:
        seen[b] += 1
        out.append(f"{b}-{seen[b]}" if count[b] > 1 else b)
    return out


def _skipped(step) -> bool:
    return step is None or step == "passthrough"


class _Named(BaseEstimator):
    """Named parts that get_params and set_params reach."""

    def _parts(self) -> list[tuple]:
        raise NotImplementedError

    def get_params(self, deep: bool = True) -> dict:
        out = super().get_params(deep=False)
        if deep:
            for name, part, *_ in self._parts():
                out[name] = part
                if hasattr(part, "get_params"):
                    out |= {f"{name}__{k}": v for k, v in part.get_params().items()}
        return out

    def set_params(self, **params):
        names = {p[0] for p in self._parts()}
        own = {k: v for k, v in params.items() if k in self._names()}
        for k, v in own.items():
            setattr(self, k, v)
        for k, v in params.items():
            if k in own:
                continue
            head, _, rest = k.partition("__")
            if head not in names:
                raise ValueError(f"Invalid parameter {head!r} for estimator {type(self).__name__}")
            if rest:
                dict((p[0], p[1]) for p in self._parts())[head].set_params(**{rest: v})
            else:
                self._replace(head, v)
        return self


class Pipeline(_Named):
    """Transformers one after the other, then an estimator; None and 'passthrough' are skipped.

    Transforms stay lazy, so each fit is one job over the fused projections before it.
    """

    def __init__(self, steps, *, transform_input=None, memory=None, verbose=False):
        self.steps, self.transform_input, self.memory, self.verbose = steps, transform_input, memory, verbose

    def _parts(self):
        return self.steps

    def _replace(self, name, value):
        self.steps = [(n, value if n == name else s) for n, s in self.steps]

    @property
    def named_steps(self) -> dict:
        return dict(self.steps)

    @property
    def _final_estimator(self):
        return self.steps[-1][1]

    def __len__(self):
        return len(self.steps)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return type(self)(self.steps[at])
        return self.steps[at][1] if isinstance(at, int) else self.named_steps[at]

    def _check(self):
        if self.memory is not None or self.transform_input is not None:
            raise NotImplementedError("memory and transform_input are not supported: cache the DataFrame instead")
        if not self.steps:
            raise ValueError("The pipeline is empty")
        names = [n for n, _ in self.steps]
        if len(set(names)) < len(names):
            raise ValueError(f"Names provided are not unique: {names}")
        for n in names:
            if "__" in n:
                raise ValueError(f"Estimator names must not contain __: got {n!r}")
            if n in self._names():
                raise ValueError(f"Estimator names conflict with constructor arguments: {n!r}")
        for n, s in self.steps[:-1]:
            if not _skipped(s) and not (hasattr(s, "fit") and hasattr(s, "transform")):
                raise TypeError(f"All intermediate steps should be transformers: {n!r} is not")

    def _routed(self, params: dict) -> dict[str, dict]:
        out: dict[str, dict] = {n: {} for n, _ in self.steps}
        for k, v in params.items():
            head, sep, rest = k.partition("__")
            if not sep or head not in out:
                raise ValueError(f"Pipeline.fit does not accept the parameter {k!r}; use step__parameter")
            out[head][rest] = v
        return out

    def _prepare(self, df, features, params):
        routed = self._routed(params)
        for n, s in self.steps[:-1]:
            if _skipped(s):
                continue
            before = df.columns
            kw = dict(routed[n])
            if features is not None and "features" not in kw and not isinstance(s, ColumnTransformer):
                kw["features"] = features
            df = s.fit(df, **kw).transform(df)
            if features is not None:
                made = s.get_feature_names_out() if hasattr(s, "get_feature_names_out") else [x for x in df.columns if x not in before]
                kept = [] if isinstance(s, ColumnTransformer) else [f for f in features if f in df.columns and f not in made and f not in getattr(s, "feature_names_in_", [])]
                features = kept + [m for m in made if m in df.columns]
        return df, features, routed

    def fit(self, df: DataFrame, features=None, label=None, **params):
        """label reaches the last step; features are followed through the transformers' output names."""
        self._check()
        df, features, routed = self._prepare(df, features, params)
        name, last = self.steps[-1]
        if not _skipped(last):
            kw = dict(routed[name])
            if features is not None and "features" not in kw and not isinstance(last, ColumnTransformer):
                kw["features"] = features
            if label is not None and "label" not in kw and not hasattr(last, "transform"):
                kw["label"] = label
            last.fit(df, **kw)
        self.fitted_ = True
        return self

    def fit_transform(self, df, features=None, label=None, **params):
        return self.fit(df, features, label, **params).transform(df)

    def _until_last(self, df):
        check_is_fitted(self, "fitted_")
        for _, s in self.steps[:-1]:
            if not _skipped(s):
                df = s.transform(df)
        return df

    def transform(self, df):
        df = self._until_last(df)
        last = self._final_estimator
        if _skipped(last):
            return df
        if not hasattr(last, "transform"):
            raise AttributeError(f"{type(last).__name__} has no transform")
        return last.transform(df)

    def inverse_transform(self, df):
        check_is_fitted(self, "fitted_")
        for _, s in reversed(self.steps):
            if not _skipped(s):
                df = s.inverse_transform(df)
        return df

    def __getattr__(self, name):
        # What only the last step can do is offered only if it can.
        if name in ("predict", "predict_proba", "predict_log_proba", "decision_function", "score", "score_samples", "classes_", "label_", "labels_", "_estimator_type"):
            last = self.__dict__.get("steps", [(None, None)])[-1][1]
            found = getattr(last, name)
            if not callable(found):
                return found
            return lambda df, *a, **kw: found(self._until_last(df), *a, **kw)
        raise AttributeError(name)

    def get_feature_names_out(self, input_features=None):
        out = input_features
        for _, s in self.steps:
            if not _skipped(s):
                out = s.get_feature_names_out()
        return list(out)


def make_pipeline(*steps, transform_input=None, memory=None, verbose=False) -> Pipeline:
    return Pipeline(list(zip(_auto_names(steps), steps, strict=True)), transform_input=transform_input, memory=memory, verbose=verbose)


class ColumnTransformer(_Named):
    """Each branch transforms its own columns; outputs stand side by side in branch order.

    All branches are projections of one input, so no join is needed, and the fits of
    branches that state their aggregates share one job. The result holds the branches'
    columns (and `keep`, columns that pass unnamed, such as ids and labels).
    """

    def __init__(self, transformers, *, remainder="drop", sparse_threshold=0.3, n_jobs=None, transformer_weights=None, verbose=False, verbose_feature_names_out=True, force_int_remainder_cols=None, keep=()):
        self.transformers, self.remainder, self.sparse_threshold, self.n_jobs = transformers, remainder, sparse_threshold, n_jobs
        self.transformer_weights, self.verbose, self.verbose_feature_names_out = transformer_weights, verbose, verbose_feature_names_out
        self.force_int_remainder_cols, self.keep = force_int_remainder_cols, keep

    def _parts(self):
        return self.transformers

    def _replace(self, name, value):
        self.transformers = [(n, value if n == name else t, *r) for n, t, *r in self.transformers]

    @staticmethod
    def resolve(df: DataFrame, selector, names: list[str]) -> list[str]:
        """Names that a selector means: name, position, slice (of names: inclusive), mask, list, or callable."""
        if callable(selector):
            selector = selector(df)
        at = lambda s: names.index(s) if s in names else _missing(s)

        def _missing(s):
            raise ValueError(f"column {s!r} is not in the table")

        def one(s):
            if isinstance(s, str):
                return names[at(s)]
            if not -len(names) <= s < len(names):
                raise ValueError(f"column {s} is out of bounds")
            return names[s]

        if isinstance(selector, (str, int)) and not isinstance(selector, bool):
            return [one(selector)]
        if isinstance(selector, slice):
            if isinstance(selector.start, str) or isinstance(selector.stop, str):
                first = 0 if selector.start is None else at(selector.start)
                last = len(names) if selector.stop is None else at(selector.stop) + 1
                return names[first : last : selector.step]
            return names[selector]
        chosen = list(selector)
        if chosen and all(isinstance(s, bool) for s in chosen):
            if len(chosen) != len(names):
                raise ValueError("a boolean mask needs one entry for each column")
            return [n for n, s in zip(names, chosen, strict=True) if s]
        out = [one(s) for s in chosen]
        if len(set(out)) < len(out):
            raise ValueError("a selector names a column twice")
        return out

    def fit(self, df: DataFrame, features=None):
        names = [n for n in df.columns if n not in self.keep]
        labels = [t[0] for t in self.transformers]
        if len(set(labels)) < len(labels):
            raise ValueError(f"Names provided are not unique: {labels}")
        branches, used = [], set()
        for name, t, selector in self.transformers:
            chosen = self.resolve(df, selector, names)
            used |= set(chosen)
            if chosen and not (isinstance(t, str) and t == "drop"):
                branches.append((name, t if isinstance(t, str) else clone(t), chosen))
        rest = [n for n in names if n not in used]
        if rest and not (isinstance(self.remainder, str) and self.remainder == "drop"):
            branches.append(("remainder", self.remainder if isinstance(self.remainder, str) else clone(self.remainder), rest))
        together = [(t, cols) for _, t, cols in branches if not isinstance(t, str) and fusible(t)]
        if together:
            fit_together(df, together)
        for _, t, cols in branches:
            if not isinstance(t, str) and not fusible(t):
                t.fit(df.select(*map(c, cols)), features=cols)
        self._branches = branches
        self._record(names)
        self.transformers_ = [(n, t, cols) for n, t, cols in branches]
        self._outputs = [(n, list(cols) if isinstance(t, str) else list(t.get_feature_names_out())) for n, t, cols in branches]
        self.get_feature_names_out()
        return self

    def get_feature_names_out(self, input_features=None) -> list[str]:
        check_is_fitted(self, "transformers_")
        how, out = self.verbose_feature_names_out, []
        for branch, names in self._outputs:
            for n in names:
                if callable(how):
                    out.append(how(branch, n))
                elif isinstance(how, str):
                    out.append(how.format(transformer_name=branch, feature_name=n))
                else:
                    out.append(f"{branch}__{n}" if how else n)
        if len(set(out)) < len(out):
            raise ValueError("Output feature names are not unique; use verbose_feature_names_out=True")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Reordered and extra input columns are accepted; missing ones are not."""
        check_is_fitted(self, "transformers_")
        needed = {n for _, _, cols in self._branches for n in cols}
        if missing := sorted(needed - set(df.columns)):
            raise ValueError(f"columns are missing: {missing}")
        weights = self.transformer_weights or {}
        # Every branch gets its own copy of its columns, so that branches never see each other's output.
        names = iter(self.get_feature_names_out())
        wide = df.select(*map(c, [k for k in self.keep if k in df.columns]), *[c(n).alias(f"__b{i}:{n}") for i, (_, _, cols) in enumerate(self._branches) for n in cols])
        made: list = []
        for i, (name, t, cols) in enumerate(self._branches):
            others = [x for x in wide.columns if not x.startswith(f"__b{i}:")]
            part = wide.select(*map(c, others), *[c(f"__b{i}:{n}").alias(n) for n in cols])
            if not isinstance(t, str):
                part = t.transform(part)
            outs = self._outputs[i][1]
            w = weights.get(name)
            wide = part.select(*map(c, others), *[(c(o) if w is None else c(o) * F.lit(float(w))).alias(f"__o{i}:{o}") for o in outs])
            made += [(f"__o{i}:{o}", next(names)) for o in outs]
        return wide.select(*[c(k) for k in self.keep if k in wide.columns], *[c(a).alias(b) for a, b in made])

    def fit_transform(self, df, features=None):
        return self.fit(df).transform(df)

    def sparse_output(self, df: DataFrame) -> bool:
        """Whether df's output is better held as coordinates: a branch is sparse, and the share of values other than zero is under sparse_threshold.

        One aggregate over the output. An empty output is not sparse; NULL counts as a value.
        """
        check_is_fitted(self, "transformers_")
        if not any(getattr(t, "sparse_output", False) for _, t, _ in self._branches):
            return False
        names = self.get_feature_names_out()
        filled = [F.count_if(F.coalesce(c(n).cast("double") != 0, F.lit(True))) for n in names]
        found = self.transform(df).agg(F.count(F.lit(1)), *filled).first()
        total = found[0] * len(names)
        return total > 0 and sum(found[1:]) / total < self.sparse_threshold

    def to_coo(self, df: DataFrame, row: str) -> DataFrame:
        """(row, col, value) for all output values other than zero; `row` is one of the `keep` columns, col a place among the output names."""
        if row not in self.keep:
            raise ValueError(f"{row!r} is not among the kept columns")
        cells = [F.struct(F.lit(i).cast("long").alias("col"), c(n).cast("double").alias("value")) for i, n in enumerate(self.get_feature_names_out())]
        some = F.filter(F.array(*cells), lambda x: F.coalesce(x["value"] != 0, F.lit(True)))
        return self.transform(df).select(c(row).alias("row"), F.explode(some).alias("x")).select("row", "x.col", "x.value")


def make_column_transformer(*pairs, **options) -> ColumnTransformer:
    names = _auto_names([t for t, _ in pairs])
    return ColumnTransformer([(n, t, s) for n, (t, s) in zip(names, pairs, strict=True)], **options)
