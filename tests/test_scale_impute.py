import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.columns import number
from millrace.operators.base import NotFittedError
from millrace.operators.compose import ColumnTransformer, Pipeline, make_pipeline
from millrace.operators.encode import OneHotEncoder
from millrace.operators.impute import SimpleImputer
from millrace.operators.scale import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler
from millrace.plans import fuse

XY = "x0 double, x1 double"


def frame(spark, data, schema=XY):
    return spark.createDataFrame(data, schema)


def values(df):
    return np.array([[np.nan if v is None else v for v in r] for r in df.collect()], dtype=float)


@pytest.mark.parametrize("mean", [True, False])
@pytest.mark.parametrize("std", [True, False])
def test_standard_scaler_round_trip(spark, mean, std):
    data = [(1.0, -5.0, 2.0), (2.0, 0.0, 2.0), (3.0, 5.0, 2.0)]
    df = frame(spark, data, "x0 double, x1 double, x2 double")
    s = StandardScaler(with_mean=mean, with_std=std).fit(df)
    np.testing.assert_allclose(values(s.inverse_transform(s.transform(df))), data, rtol=1e-12)
    assert (s.mean_ is None) == (not mean and not std)
    assert (s.var_ is None) == (not std)


def test_standard_scaler_statistics(spark):
    s = StandardScaler().fit(frame(spark, [(1, 10), (3, 10)], "x0 long, x1 long"))
    assert s.mean_.tolist() == [2, 10] and s.var_.tolist() == [1, 0] and s.scale_.tolist() == [1, 1]
    assert s.n_samples_seen_ == 2


def test_partial_fits_equal_one_fit(spark):
    a, b = [(1.0, 3.0), (2.0, None)], [(5.0, 8.0), (7.0, float("nan"))]
    for kind in (StandardScaler, MinMaxScaler, MaxAbsScaler):
        parts, whole = kind(), kind().fit(frame(spark, a + b))
        parts.partial_fit(frame(spark, a)).partial_fit(frame(spark, b))
        np.testing.assert_allclose(parts.scale_, whole.scale_, rtol=1e-12)


def test_column_that_is_missing_at_first(spark):
    s = StandardScaler().partial_fit(frame(spark, [(1.0, None)])).partial_fit(frame(spark, [(2.0, 4.0), (3.0, 8.0)]))
    assert s.mean_.tolist() == [2.0, 6.0] and s.var_[1] == 4.0


def test_infinity_is_refused_and_missing_stays(spark):
    with pytest.raises(ValueError, match="infinity"):
        StandardScaler().fit(frame(spark, [(1.0, math.inf)]))
    out = StandardScaler().fit_transform(frame(spark, [(1.0, float("nan")), (3.0, 2.0)]))
    assert out.collect()[0]["x1"] is None


def test_minmax(spark):
    df = frame(spark, [(-2.0, 4.0), (0.0, 4.0), (2.0, 4.0)])
    s = MinMaxScaler((-1, 2)).fit(df)
    np.testing.assert_allclose(values(s.transform(df)), [[-1, -1], [0.5, -1], [2, -1]])
    assert s.data_range_.tolist() == [4, 0]
    one = MinMaxScaler().fit(frame(spark, [(0.0,), (10.0,)], "x0 double"))
    test = frame(spark, [(-5.0,), (15.0,), (None,)], "x0 double")
    np.testing.assert_allclose(values(one.transform(test))[:2, 0], [-0.5, 1.5])
    one.clip = True
    clipped = one.transform(test).collect()
    assert [r[0] for r in clipped] == [0.0, 1.0, None]


def test_max_abs(spark):
    s = MaxAbsScaler().fit(frame(spark, [(0.0, 2.0, 0.0), (-4.0, 0.0, None), (0.0, -8.0, 0.0)], "x0 double, x1 double, x2 double"))
    assert s.max_abs_.tolist() == [4, 8, 0] and s.scale_.tolist() == [4, 8, 1]


def test_robust(spark):
    s = RobustScaler().fit(frame(spark, [(1.0, 10.0), (2.0, 20.0), (100.0, 30.0)]))
    assert s.center_.tolist() == [2, 20] and s.scale_.tolist() == [49.5, 10]
    e = RobustScaler().fit(frame(spark, [(4.0, None), (4.0, None)]))
    assert e.center_[0] == 4 and np.isnan(e.center_[1]) and e.scale_[0] == 1
    with np.errstate(all="ignore"):
        assert RobustScaler(quantile_range=(0, 100), unit_variance=True).fit(frame(spark, [(1.0, 2.0), (3.0, 5.0)])).scale_[0] == 0
        assert RobustScaler(quantile_range=(50, 50), unit_variance=True).fit(frame(spark, [(1.0, 2.0), (3.0, 5.0)])).scale_[0] == np.inf


def test_percentiles_of_many_values_stay_small(spark):
    """No task reads the values of a column, however many there are."""
    n, sc = 400_000, spark.sparkContext
    df = spark.range(0, n, 1, 4).select(((F.col("id") * 7919 % n).cast("double") / 3).alias("x"))
    sc.setJobGroup("percentiles", "")
    s, m = RobustScaler().fit(df), SimpleImputer(strategy="median").fit(df)
    jobs = map(sc.statusTracker().getJobInfo, sc.statusTracker().getJobIdsForGroup("percentiles"))
    read = [sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleReadBytes() for j in jobs for k in j.stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < max(read) < 1_000_000
    want = np.percentile(np.arange(n) / 3, [25, 50, 75])
    np.testing.assert_allclose([s.center_[0], s.scale_[0], m.statistics_[0]], [want[1], want[2] - want[0], want[1]], rtol=1e-12)


def test_percentiles_of_odd_values(spark, monkeypatch):
    monkeypatch.setattr(fuse, "COLUMNS", 2)  # several passes of columns
    rng = np.random.default_rng(3)
    data = np.stack(
        [
            rng.standard_normal(301) * 10.0 ** rng.integers(-300, 300, 301),
            -np.exp(rng.standard_normal(301)),
            np.where(rng.random(301) < 0.8, -0.0, rng.integers(-2, 3, 301)),
            rng.permutation(301) * 5e-324,
            np.nextafter(1.0, 2.0) + rng.permutation(301) * 2.0**-52,
            rng.choice([-1.7e308, 1.7e308], 301),
            np.full(301, 4.5),
        ],
        axis=1,
    )
    df = frame(spark, [tuple(map(float, r)) for r in data] + [(None,) * 6 + (float("nan"),)], ", ".join(f"x{i} double" for i in range(7))).repartition(3)
    for low, high in ((25.0, 75.0), (0.0, 100.0), (10.0, 33.3)):
        wanted = [fuse.Percentiles(number(df, n), [low / 100, high / 100]) for n in df.columns]
        first = [tuple(df.agg(*w.first()).first()) for w in wanted]
        found = fuse.percentiles(df, wanted, first)
        old = df.agg(*[F.percentile(number(df, n), F.array(F.lit(low / 100), F.lit(high / 100))) for n in df.columns]).first()
        assert [list(x) for x in old] == found
    with pytest.raises(ValueError, match="infinity"):
        RobustScaler().fit(frame(spark, [(1.0,), (float("inf"),), (2.0,)], "x0 double"))


@pytest.mark.parametrize(("norm", "want"), [("l1", [3 / 7, 4 / 7]), ("l2", [0.6, 0.8]), ("max", [0.75, 1])])
def test_normalizer(spark, norm, want):
    df = frame(spark, [(0.0, 0.0), (3.0, 4.0), (1e-308, 1e-308)])
    out = values(Normalizer(norm).fit(df).transform(df))
    np.testing.assert_allclose(out, [[0, 0], want, [1e-308, 1e-308]])


def test_float_columns_stay_float(spark):
    df = frame(spark, [(1.0, None), (2.0, 4.0), (5.0, 8.0)], "x0 float, x1 float")
    assert [t for _, t in RobustScaler().fit_transform(df).dtypes] == ["float", "float"]


def test_unfitted_and_missing_columns(spark):
    df = frame(spark, [(1.0, 2.0)])
    with pytest.raises(NotFittedError):
        StandardScaler().transform(df)
    with pytest.raises(ValueError, match="missing"):
        StandardScaler().fit(df).transform(df.drop("x1"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=2, max_size=12))
def test_inverse_undoes_transform(spark, data):
    df = frame(spark, data)
    for s in (StandardScaler(), MinMaxScaler(), MaxAbsScaler()):
        s.fit(df)
        np.testing.assert_allclose(values(s.inverse_transform(s.transform(df))), np.array(data), atol=1e-6)


@pytest.mark.parametrize(("strategy", "fill"), [("mean", [2, 6, 2]), ("median", [2, 6, 2]), ("most_frequent", [1, 4, 1]), ("constant", [-5, -5, -5])])
def test_imputer_statistics(spark, strategy, fill):
    df = frame(spark, [(1.0, 4.0, 1.0), (None, 8.0, 2.0), (3.0, None, 3.0)], "x0 double, x1 double, x2 double")
    s = SimpleImputer(strategy=strategy, fill_value=-5 if strategy == "constant" else None).fit(df)
    assert s.statistics_.tolist() == fill


def test_imputer_strings_sentinel_and_empty(spark, rows):
    df = frame(spark, [("b", None), ("a", "x"), ("a", None)], "x0 string, x1 string")
    out = SimpleImputer(strategy="most_frequent").fit(df).transform(df)
    assert [tuple(r) for r in out.collect()] == [("b", "x"), ("a", "x"), ("a", "x")]
    df = frame(spark, [(1.0, -1.0), (3.0, 5.0)], "x0 float, x1 float")
    assert values(SimpleImputer(missing_values=-1).fit_transform(df)).tolist() == [[1, 5], [3, 5]]
    df = frame(spark, [("a",), ("?",)], "x0 string")
    assert [r[0] for r in SimpleImputer(missing_values="?", strategy="constant").fit_transform(df).collect()] == ["a", "missing_value"]
    df = frame(spark, [(1.0, None), (3.0, None)])
    with pytest.warns(UserWarning, match="Skipping"):
        assert SimpleImputer().fit(df).transform(df).columns == ["x0"]
    assert values(SimpleImputer(keep_empty_features=True).fit_transform(df)).tolist() == [[1, 0], [3, 0]]


def test_imputer_indicator(spark):
    df = frame(spark, [(1.0, None), (None, 2.0)])
    s = SimpleImputer(add_indicator=True).fit(df)
    assert s.get_feature_names_out() == ["x0", "x1", "missingindicator_x0", "missingindicator_x1"]
    assert values(s.transform(df)).tolist() == [[1, 2, 0, 1], [1, 2, 1, 0]]
    assert [tuple(r) for r in s.inverse_transform(s.transform(df)).collect()] == [(1.0, None), (None, 2.0)]


def test_column_transformer(spark):
    df = frame(spark, [(20.0, "a", 1), (None, "b", 2), (40.0, "a", 3)], "age double, city string, unused long")
    t = ColumnTransformer(
        [("num", make_pipeline(SimpleImputer(), StandardScaler()), ["age"]), ("cat", make_pipeline(SimpleImputer(strategy="most_frequent"), OneHotEncoder()), ["city"])]
    ).fit(df)
    np.testing.assert_allclose(values(t.transform(df)), [[-1.2247448, 1, 0], [0, 0, 1], [1.2247448, 1, 0]], rtol=1e-6)
    assert t.get_feature_names_out() == ["num__age", "cat__city_a", "cat__city_b"]
    np.testing.assert_allclose(values(t.transform(df.select("unused", "city", "age"))), values(t.transform(df)))
    with pytest.raises(ValueError, match="missing"):
        t.transform(df.drop("city"))


def test_remainder_weights_and_selectors(spark):
    df = frame(spark, [(1.0, 10.0, 100.0, 5.0), (3.0, 30.0, 200.0, 7.0)], "x0 double, x1 double, x2 double, x3 double")
    t = ColumnTransformer([("s", StandardScaler(), slice(0, 2)), ("d", "drop", [2])], remainder="passthrough")
    assert values(t.fit_transform(df)).tolist() == [[-1, -1, 5], [1, 1, 7]]
    df = frame(spark, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x0 double, x1 double, x2 double")
    t = ColumnTransformer(
        [("a", "passthrough", 0), ("b", "passthrough", [False, True, False]), ("c", "passthrough", lambda d: ["x2"])],
        transformer_weights={"b": 10},
        verbose_feature_names_out=False,
    )
    assert values(t.fit_transform(df)).tolist() == [[1, 20, 3], [4, 50, 6]]


def test_pipeline_parameters(spark):
    p = Pipeline([("scale", StandardScaler()), ("skip", "passthrough")])
    p.set_params(scale__with_mean=False)
    assert p.get_params()["scale__with_mean"] is False and p["scale"].with_mean is False
    with pytest.raises(ValueError, match="Invalid parameter"):
        p.set_params(other=1)
    assert not hasattr(p, "predict")
    assert [n for n, _ in make_pipeline(StandardScaler(), StandardScaler()).steps] == ["standardscaler-1", "standardscaler-2"]
    with pytest.raises(NotImplementedError):
        Pipeline([("a", StandardScaler())], memory="x").fit(frame(spark, [(1.0, 2.0)]))
