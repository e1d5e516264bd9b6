"""Estimator protocol: parameters, cloning, fitted state, errors."""

from __future__ import annotations

import copy
import inspect
import warnings


class NotFittedError(ValueError, AttributeError):
    """An estimator is used before fit."""


class ConvergenceWarning(UserWarning):
    """An iterative solver stopped before it converged."""


class UndefinedMetricWarning(UserWarning):
    """A metric has no defined value for its input."""


class FitFailedWarning(RuntimeWarning):
    """A fold of a cross-validation could not be fitted or scored."""


class BaseEstimator:
    """Parameters are the constructor's keywords; nested ones are reached as `part__name`."""

    @classmethod
    def _names(cls) -> list[str]:
        if cls.__init__ is object.__init__:
            return []
        found = []
        for p in list(inspect.signature(cls.__init__).parameters.values())[1:]:
            if p.kind is p.VAR_POSITIONAL:
                raise RuntimeError(f"{cls.__name__} must name every constructor parameter")
            if p.kind is not p.VAR_KEYWORD:
                found.append(p.name)
        return sorted(found)

    def get_params(self, deep: bool = True) -> dict:
        out = {}
        for name in self._names():
            out[name] = value = getattr(self, name)
            if deep and hasattr(value, "get_params") and not isinstance(value, type):
                out |= {f"{name}__{k}": v for k, v in value.get_params().items()}
        return out

    def set_params(self, **params):
        known = self.get_params(deep=True)
        nested: dict[str, dict] = {}
        for key, value in params.items():
            head, _, rest = key.partition("__")
            if head not in known:
                raise ValueError(f"Invalid parameter {head!r} for estimator {self!r}")
            if rest:
                nested.setdefault(head, {})[rest] = value
            else:
                setattr(self, head, value)
                known[head] = value
        for head, inner in nested.items():
            known[head].set_params(**inner)
        return self

    def __repr__(self) -> str:
        shown = ", ".join(f"{k}={v!r}" for k, v in self.get_params(deep=False).items())
        return f"{type(self).__name__}({shown})"

    # What the last fit recorded about its input.
    def _record(self, features: list[str]) -> None:
        self.features_ = list(features)
        self.n_features_in_ = len(features)
        self.feature_names_in_ = list(features)

    def _require(self, df) -> list[str]:
        check_is_fitted(self)
        missing = [f for f in self.feature_names_in_ if f not in df.columns]
        if missing:
            raise ValueError(f"columns seen at fit are missing: {missing}")
        return self.feature_names_in_


def clone(estimator, *, safe: bool = True):
    """An unfitted copy. Containers are copied with their items cloned, dictionaries by value; other things without parameters are copied deeply unless `safe`."""
    again = lambda item: clone(item, safe=safe)
    match estimator:
        case dict():
            return type(estimator)((k, again(v)) for k, v in estimator.items())
        case list() | tuple() | set() | frozenset():
            return type(estimator)(map(again, estimator))
        case type():
            own = None
        case _:
            if special := getattr(estimator, "__sklearn_clone__", None):
                return special()
            own = getattr(estimator, "get_params", None)
    if own is None:
        if safe:
            raise TypeError(f"cannot clone {estimator!r}: it has no get_params")
        return copy.deepcopy(estimator)
    given = {name: clone(value, safe=False) for name, value in own(deep=False).items()}
    made = type(estimator)(**given)
    changed = [name for name, value in given.items() if getattr(made, name) is not value]
    if changed:
        raise RuntimeError(f"the constructor of {type(estimator).__name__} changes its parameter {changed[0]!r}")
    return made


class TransformerMixin:
    def fit_transform(self, df, *args, **kwargs):
        return self.fit(df, *args, **kwargs).transform(df)


class OneToOneMixin(TransformerMixin):
    """Output columns carry the input names."""

    def get_feature_names_out(self, input_features=None) -> list[str]:
        check_is_fitted(self)
        if input_features is not None and list(input_features) != self.feature_names_in_:
            raise ValueError("input_features is not equal to feature_names_in_")
        return list(self.feature_names_in_)


class ClassifierMixin:
    _estimator_type = "classifier"

    def score(self, df, label: str | None = None, weight: str | None = None) -> float:
        from .metrics import accuracy_score

        label = label or self.label_
        return accuracy_score(self.predict(df, keep=[label, *([weight] if weight else [])]), label, "prediction", weight=weight)


class RegressorMixin:
    _estimator_type = "regressor"

    def score(self, df, label=None) -> float:
        from .metrics import r2_score

        labels = label or self.labels_
        labels = [labels] if isinstance(labels, str) else list(labels)
        guesses = ["prediction"] if len(labels) == 1 else [f"prediction_{i}" for i in range(len(labels))]
        return r2_score(self.predict(df, keep=labels), labels, guesses)


def check_is_fitted(estimator, attributes: list[str] | str | None = None) -> None:
    if isinstance(attributes, str):
        attributes = [attributes]
    fitted = all(hasattr(estimator, a) for a in attributes) if attributes else any(a.endswith("_") and not a.startswith("__") for a in vars(estimator))
    if not fitted:
        raise NotFittedError(f"This {type(estimator).__name__} instance is not fitted yet")


def warn(message: str, kind: type[Warning] = UserWarning) -> None:
    warnings.warn(message, kind, stacklevel=3)
