"""Estimators, metrics, splits and solvers."""

from .base import BaseEstimator, ClassifierMixin, NotFittedError, RegressorMixin, TransformerMixin, check_is_fitted, clone
from .compose import ColumnTransformer, Pipeline, make_column_transformer, make_pipeline
from .encode import LabelEncoder, OneHotEncoder, OrdinalEncoder
from .impute import SimpleImputer
from .linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from .metrics import accuracy_score, confusion_matrix, f1_score, mean_absolute_error, mean_squared_error, precision_score, r2_score, recall_score
from .neighbors import KNeighborsClassifier, KNeighborsRegressor
from .scale import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler
from .sparse import SparseMaxAbsScaler, SparseStandardScaler
from .split import BaseCrossValidator, KFold, StratifiedKFold, train_test_split
from .validate import cross_val_score

__all__ = [
    "BaseCrossValidator", "BaseEstimator", "ClassifierMixin", "ColumnTransformer", "ElasticNet", "KFold", "KNeighborsClassifier",
    "KNeighborsRegressor", "LabelEncoder", "Lasso", "LinearRegression", "LogisticRegression", "MaxAbsScaler", "MinMaxScaler",
    "Normalizer", "NotFittedError", "OneHotEncoder", "OrdinalEncoder", "Pipeline", "RegressorMixin", "Ridge", "RobustScaler",
    "SimpleImputer", "SparseMaxAbsScaler", "SparseStandardScaler", "StandardScaler", "StratifiedKFold", "TransformerMixin",
    "accuracy_score", "check_is_fitted", "clone", "confusion_matrix", "cross_val_score", "f1_score", "make_column_transformer",
    "make_pipeline", "mean_absolute_error", "mean_squared_error", "precision_score", "r2_score", "recall_score", "train_test_split",
]
