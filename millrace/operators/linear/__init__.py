"""Linear models on one distributed Gram aggregate, and logistic regression."""

from .coordinate import ElasticNet, Lasso
from .least_squares import LinearRegression, Ridge
from .logistic import LogisticRegression

__all__ = ["ElasticNet", "Lasso", "LinearRegression", "LogisticRegression", "Ridge"]
