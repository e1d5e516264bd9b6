import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators.base import ConvergenceWarning, FitFailedWarning, clone
from millrace.operators.compose import make_pipeline
from millrace.operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from millrace.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from millrace.operators.scale import StandardScaler
from millrace.operators.split import KFold, StratifiedKFold, class_shares, sizes, train_test_split, with_position
from millrace.operators.validate import cross_val_score


def table(spark, x, y, w=None):
    x, y = np.asarray(x, float), np.asarray(y)
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [tuple(map(float, r)) + (v.item(),) + ((float(w[i]),) if w is not None else ()) for i, (r, v) in enumerate(zip(x, y))]
    kind = "string" if y.dtype.kind == "U" else "double" if y.dtype.kind == "f" else "long"
    return spark.createDataFrame(rows, ", ".join([*(f"{n} double" for n in names), f"y {kind}"] + ["w double"] * (w is not None))), names


def pairs(spark, t, p, w=None):
    kind = "string" if isinstance(t[0], str) else "long"
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in zip(t, p, w or [1] * len(t))], f"t {kind}, p {kind}, w double")


def test_accuracy(spark):
    df = pairs(spark, [0, 1, 1], [0, 0, 1])
    assert M.accuracy_score(df, "t", "p") == pytest.approx(2 / 3)
    assert M.accuracy_score(df, "t", "p", normalize=False) == 2
    assert M.accuracy_score(pairs(spark, ["a", "b"], ["a", "a"], [1, 3]), "t", "p", weight="w") == 0.25
    with pytest.raises(ZeroDivisionError):
        M.accuracy_score(pairs(spark, [1], [1], [0]), "t", "p", weight="w")


def test_confusion_matrix(spark):
    df = pairs(spark, [0, 1, 1, 2], [0, 0, 1, 1], [1, 2, 3, 4])
    assert M.confusion_matrix(df, "t", "p").tolist() == [[1, 0, 0], [1, 1, 0], [0, 1, 0]]
    assert M.confusion_matrix(df, "t", "p", labels=[2, 1, 0], weight="w").tolist() == [[0, 4, 0], [0, 3, 2], [0, 0, 1]]
    assert M.confusion_matrix(df, "t", "p", normalize="true").tolist() == [[1, 0, 0], [0.5, 0.5, 0], [0, 1, 0]]
    with pytest.raises(ValueError, match="At least one label"):
        M.confusion_matrix(df, "t", "p", labels=[7])


def test_class_scores(spark):
    df = pairs(spark, [0, 1, 2, 2], [0, 2, 2, 1])
    assert M.precision_score(df, "t", "p", average=None).tolist() == [1, 0, 0.5]
    for score in (M.precision_score, M.recall_score, M.f1_score):
        for average in ("micro", "macro", "weighted"):
            assert score(df, "t", "p", average=average) == pytest.approx(0.5)
    with pytest.raises(ValueError, match="multiclass"):
        M.f1_score(df, "t", "p")
    none = pairs(spark, [0, 0], [0, 0])
    assert M.precision_score(none, "t", "p", labels=[0, 1], average=None, zero_division=1).tolist() == [1, 1]
    with pytest.warns(Warning):
        assert M.precision_score(none, "t", "p", labels=[0, 1], average=None).tolist() == [1, 0]
    assert np.isnan(M.precision_score(none, "t", "p", labels=[0, 1], average=None, zero_division=np.nan)[1])


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 3.0, 1.0), (3.0, 5.0, 2.0, 5.0, 2.0), (6.0, 8.0, 8.0, 7.0, 3.0)], "t0 double, t1 double, p0 double, p1 double, w double")
    t, p = ["t0", "t1"], ["p0", "p1"]
    np.testing.assert_allclose(M.mean_squared_error(df, t, p, multioutput="raw_values"), [5 / 3, 2 / 3])
    np.testing.assert_allclose(M.mean_absolute_error(df, t, p, multioutput="raw_values"), [1, 2 / 3])
    assert M.mean_squared_error(df, t, p, weight="w") == pytest.approx(1.5)
    np.testing.assert_allclose(M.r2_score(df, t, p, multioutput="raw_values"), [0.60526316, 0.88888889])
    flat = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 1.0, 2.0)], "t double, a double, b double")
    assert M.r2_score(flat, "t", "a") == 1 and M.r2_score(flat, "t", "b") == 0
    assert M.r2_score(flat, "t", "b", force_finite=False) == -np.inf
    with pytest.warns(Warning):
        assert np.isnan(M.r2_score(flat.limit(1), "t", "a"))


def test_positions_over_several_ranges(spark, monkeypatch):
    from millrace.operators import split

    monkeypatch.setattr(split, "RANGE_ROWS", 50)
    monkeypatch.setattr(split, "GROUP", 4)
    df = spark.createDataFrame([((i * 7919) % 1000,) for i in range(1000)], "id long").repartition(5)
    assert all(r["id"] == r["__position"] for r in with_position(df, "id").collect())


@pytest.mark.parametrize("metric", ["manhattan", "euclidean"])
def test_nearest_rows_in_tiles(metric):
    import tracemalloc

    from millrace.operators.neighbors import nearest

    rng = np.random.default_rng(5)
    t = rng.integers(0, 3, (9000, 6)).astype(float)  # many ties
    ids, q = rng.permutation(9000), t[:40] + rng.integers(0, 2, (40, 6)) / 2
    gap = np.abs(q[:, None] - t[None])
    exact = gap.sum(2) if metric == "manhattan" else np.sqrt((gap * gap).sum(2))
    for own in (None, ids[:40]):
        seen = exact if own is None else np.where(own[:, None] == ids, np.inf, exact)
        order = np.array([np.lexsort((ids, seen[r]))[:7] for r in range(40)])
        d, i = nearest(q, t, ids, 7, metric, own)
        assert (i == ids[order]).all() and np.allclose(d, np.take_along_axis(seen, order, 1), rtol=1e-15)
    few = nearest(q, t[:4], ids[:4], 7, metric)
    assert np.isfinite(few[0]).sum(1).tolist() == [4] * 40
    t, q = rng.random((20_000, 64)), rng.random((512, 64))
    tracemalloc.start()
    nearest(q, t, np.arange(20_000), 5, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


def test_ranges_take_few_comparisons_a_row(spark, monkeypatch):
    from millrace.operators import split

    monkeypatch.setattr(split, "RANGE_ROWS", 5)
    df = spark.createDataFrame([((i * 7919) % 1000, None if i % 7 == 0 else i % 5) for i in range(1000)], "id long, y long").repartition(5)
    # A digest tells its range without bounds.
    shuffled = KFold(7, shuffle=True, random_state=3).assign(df.select("id"), "id")
    assert "lambda" not in shuffled._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    assert {r["id"]: r["fold"] for r in shuffled.collect()} == {i: f for f, part in enumerate(np.array_split(order, 7)) for i in part.tolist()}
    # Bounds are searched by halves, nulls and several keys included: 8 steps for 199 bounds.
    plan = with_position(df, ["y", "id"])
    assert "filter(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(plan.collect(), key=lambda r: r["__position"])
    assert [(r["y"], r["id"]) for r in rows] == sorted(((r["y"], r["id"]) for r in rows), key=lambda v: (v[0] is not None, v))


def test_positions_within_classes_over_several_ranges(spark, monkeypatch):
    from millrace.operators import split

    monkeypatch.setattr(split, "RANGE_ROWS", 50)
    df = spark.createDataFrame([((i * 7919) % 1000, None if i % 9 == 0 else i % 3) for i in range(1000)], "id long, y long").repartition(5)
    df = df.withColumn("y", F.coalesce("y", F.lit(9)))
    got = with_position(df, "id", within="y").collect()
    for y in {r["y"] for r in got}:
        assert [r["__position"] for r in sorted((r for r in got if r["y"] == y), key=lambda r: r["id"])] == list(range(sum(r["y"] == y for r in got)))
    assert len(got) == 1000


def test_folds(spark):
    df = spark.createDataFrame([(i, i // 6) for i in range(12)], "id long, y long")
    got = sorted((r["id"], r["fold"]) for r in KFold(5).assign(df, "id").collect())
    assert [f for _, f in got] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4]
    folded = StratifiedKFold(3).assign(df, "id", "y").collect()
    assert all(sum(r["fold"] == f and r["y"] == y for r in folded) == 2 for f in range(3) for y in range(2))
    digest = lambda seed, i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    order = sorted(range(12), key=lambda i: digest(3, i))
    want = {i: f for f, part in enumerate(np.array_split(order, 5)) for i in part.tolist()}
    assert {r["id"]: r["fold"] for r in KFold(5, shuffle=True, random_state=3).assign(df, "id").collect()} == want
    mixed = StratifiedKFold(3, shuffle=True, random_state=3).assign(df, "id", "y").collect()
    for y in range(2):
        got = [r["fold"] for r in sorted(mixed, key=lambda r: digest(3, r["id"])) if r["y"] == y]
        assert got == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError, match="no effect"):
        KFold(3, random_state=1)
    with pytest.raises(ValueError, match="greater"):
        KFold(13).assign(df, "id")
    with pytest.warns(UserWarning, match="least populated"):
        StratifiedKFold(3).assign(df.filter("id < 8"), "id", "y")
    with pytest.raises(ValueError, match="each class"):
        StratifiedKFold(7).assign(df, "id", "y")


def test_train_test_split(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(12)], "id long, y long")
    train, test = train_test_split(df, "id", shuffle=False)
    assert sorted(r["id"] for r in test.collect()) == [9, 10, 11] and train.count() == 9
    train, test = train_test_split(df, "id", test_size=5, random_state=42)
    assert {r["id"] for r in test.collect()} == set(sorted(range(12), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:5])
    assert {r["id"] for r in test.collect()} | {r["id"] for r in train.collect()} == set(range(12))
    train, test = train_test_split(df, "id", test_size=0.5, random_state=0, stratify="y")
    assert [test.filter(f"y = {k}").count() for k in range(3)] == [2, 2, 2] and train.count() == 6
    train, test = train_test_split(df, "id", test_size=4, train_size=5, random_state=1)
    assert test.count() == 4 and train.count() == 5 and not train.join(test, "id").count()
    rng = np.random.default_rng(0)
    for _ in range(50):
        counts = rng.integers(2, 40, 5).tolist()
        take = int(rng.integers(1, sum(counts)))
        got = class_shares(counts, take, list("abcde"))
        assert sum(got) == take and all(abs(g - n * take / sum(counts)) < 1 for g, n in zip(got, counts, strict=True))
    assert sizes(10, 0.25) == (7, 3) and sizes(10, None, 0.5) == (5, 5)


def test_least_squares(spark):
    x = [(1, 2), (2, 0), (3, 1), (4, 3)]
    rows = [(float(a), float(b), 1 + 2 * a + 1.5 * b, 4.0 - a + 2 * b) for a, b in x]
    df = spark.createDataFrame(rows, "x0 double, x1 double, y0 double, y1 double")
    m = LinearRegression().fit(df, ["x0", "x1"], ["y0", "y1"])
    np.testing.assert_allclose(m.coef_, [[2, 1.5], [-1, 2]], atol=1e-9)
    np.testing.assert_allclose(m.intercept_, [1, 4], atol=1e-9)
    assert m.score(df) == pytest.approx(1)


def test_rank_deficient_weighted(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0, 1.0), (2.0, 4.0, 4.0, 1.0), (3.0, 6.0, 6.0, 1.0), (100.0, 200.0, -100.0, 0.0)], "x0 double, x1 double, y double, w double")
    m = LinearRegression().fit(df, ["x0", "x1"], "y", "w")
    got = [r["prediction"] for r in m.predict(df.limit(3)).collect()]
    np.testing.assert_allclose(got, [2, 4, 6], atol=1e-8)
    assert m.rank_ == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10), st.integers(2, 6), st.integers(0, 100))
def test_least_squares_against_numpy(spark, power, width, seed):
    rng = np.random.default_rng(seed)
    u, _ = np.linalg.qr(rng.standard_normal((90, width)))
    v, _ = np.linalg.qr(rng.standard_normal((width, width)))
    x = u * np.logspace(0, -power, width) @ v
    y = x @ rng.standard_normal(width) + 0.01 * rng.standard_normal(90)
    df, names = table(spark, x, y)
    m = LinearRegression(tol=1e-13).fit(df, names, "y")
    xc, yc = x - x.mean(0), y - y.mean()
    want = xc @ np.linalg.lstsq(xc, yc, rcond=1e-13)[0] + y.mean()
    got = x @ m.coef_ + m.intercept_
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-7)


def test_ridge_and_wide_gram(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal((60, 4)), rng.uniform(0.1, 2, 60)
    y = x @ [1, -2, 0.5, 0] + rng.standard_normal(60)
    df, names = table(spark, x, y, w)
    sw = w / w.sum()
    xc, yc = x - sw @ x, y - sw @ y
    want = np.linalg.solve((xc * w[:, None]).T @ xc + 10 * np.eye(4), (xc * w[:, None]).T @ yc)
    np.testing.assert_allclose(Ridge(10.0).fit(df, names, "y", "w").coef_, want, rtol=1e-8)
    from millrace.operators.linear import gram

    monkeypatch.setattr(gram, "SQL_COLUMNS", 2)
    np.testing.assert_allclose(Ridge(10.0).fit(df, names, "y", "w").coef_, want, rtol=1e-8)


def test_lasso_and_elastic_net(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 6))
    y = x @ [3, 0, 0, -2, 0, 0.1] + 0.1 * rng.standard_normal(80)
    df, names = table(spark, x, y)
    m = ElasticNet(0.1, l1_ratio=0.7, tol=1e-10).fit(df, names, "y")
    xc, yc = x - x.mean(0), y - y.mean()
    g = xc.T @ (yc - xc @ m.coef_) / 80 - 0.03 * m.coef_
    active = m.coef_ != 0
    np.testing.assert_allclose(g[active], 0.07 * np.sign(m.coef_[active]), atol=1e-8)
    assert (np.abs(g[~active]) <= 0.07 + 1e-8).all() and abs(m.dual_gap_) < 1e-8
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, -1.0, 1.0), (2.0, -2.0, 1.0), (10.0, 100.0, 0.0)], "x0 double, y double, w double")
    assert Lasso(0.1).fit(df, ["x0"], "y", "w").coef_[0] < 0
    assert Lasso(0.1, positive=True).fit(df, ["x0"], "y", "w").coef_[0] == 0
    with pytest.warns(ConvergenceWarning):
        Lasso(0.01, max_iter=1, tol=1e-12).fit(df, ["x0"], "y", "w")


def test_logistic_binary(spark):
    x = [[-3], [-2], [-1], [1], [2], [3]]
    df, names = table(spark, x, np.array(["negative"] * 3 + ["positive"] * 3))
    m = LogisticRegression().fit(df, names, "y")
    assert m.classes_.tolist() == ["negative", "positive"] and m.coef_.shape == (1, 1)
    assert m.score(df) == 1
    p = m.predict_proba(df, keep=[]).collect()
    assert all(r[0] + r[1] == pytest.approx(1) for r in p)
    # At the optimum the gradient of the stated objective is zero.
    xs, ys = np.array(x, float)[:, 0], np.array([0] * 3 + [1] * 3)
    q = 1 / (1 + np.exp(-(xs * m.coef_[0, 0] + m.intercept_[0])))
    assert (xs * (q - ys)).sum() + m.coef_[0, 0] == pytest.approx(0, abs=1e-4)
    with pytest.raises(ValueError, match="two classes"):
        LogisticRegression().fit(df.filter("y = 'positive'"), names, "y")


def test_logistic_three_classes_and_cross_validation(spark):
    rng = np.random.default_rng(2)
    centre = np.array([(-4, 0), (4, 0), (0, 5)])
    y = np.repeat(["left", "right", "top"], 8)
    x = np.repeat(centre, 8, axis=0) + 0.3 * rng.standard_normal((24, 2))
    df, _ = table(spark, np.column_stack([np.arange(24), x]), y)
    model = make_pipeline(StandardScaler(), LogisticRegression())
    model.fit(df, features=["x1", "x2"], label="y")
    assert [r["prediction"] for r in sorted(model.predict(df).collect(), key=lambda r: r["x0"])] == y.tolist()
    scores = cross_val_score(model, df, ["x1", "x2"], "y", order_by="x0", cv=3)
    assert len(scores) == 3 and scores.min() > 0.9
    with pytest.warns(FitFailedWarning), pytest.raises(ValueError, match="all folds"):
        cross_val_score(Ridge(-1.0), df, ["x1"], "x2", order_by="x0", cv=2)


def test_neighbours(spark):
    df = spark.createDataFrame([(0, 0.0, "left"), (1, 1.0, "left"), (2, 10.0, "right"), (3, 11.0, "right")], "id long, x0 double, y string")
    m = KNeighborsClassifier(1).fit(df, ["x0"], "y", "id")
    assert m.score(df) == 1
    selfless = spark.createDataFrame([(0, 0.0), (1, 3.0), (2, 7.0)], "id long, x0 double")
    near = KNeighborsRegressor(1).fit(selfless, ["x0"], None, "id").kneighbors()
    assert sorted((r["query"], r["neighbor"], r["distance"]) for r in near.collect()) == [(0, 1, 3.0), (1, 0, 3.0), (2, 1, 4.0)]
    with pytest.raises(ValueError, match="n_neighbors"):
        KNeighborsRegressor(3).fit(selfless, ["x0"], None, "id").kneighbors()


def test_neighbours_exact_matches_and_ties(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (1, 0.0, 1), (2, 10.0, 1)], "id long, x0 double, y long")
    p = KNeighborsClassifier(3, weights="distance").fit(df, ["x0"], "y", "id").predict_proba(df.filter("id = 0"), keep=[]).first()
    assert tuple(p) == (0.5, 0.5)
    assert KNeighborsClassifier(3, weights="distance").fit(df, ["x0"], "y", "id").predict(df.filter("id = 0"), keep=[]).first()[0] == 0
    t = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 2.0), (2, 10.0, 100.0)], "id long, x0 double, y double")
    assert KNeighborsRegressor(3, weights="distance").fit(t, ["x0"], "y", "id").predict(t.filter("id = 0"), keep=[]).first()[0] == 1


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_against_brute_force(spark, p, monkeypatch):
    from millrace.operators import neighbors

    rng = np.random.default_rng(4)
    t, q = rng.integers(0, 4, (40, 3)).astype(float), rng.integers(0, 4, (9, 3)).astype(float)
    tf = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "id long, a double, b double, c double")
    qf = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "id long, a double, b double, c double")
    for cells in (10**6, 36):  # one block, several blocks
        monkeypatch.setattr(neighbors, "BLOCK_CELLS", cells)
        got = KNeighborsRegressor(4, p=p).fit(tf, ["a", "b", "c"], None, "id").kneighbors(qf)
        got = sorted((r["query"], r["rank"], r["neighbor"]) for r in got.collect())
        d = (np.abs(q[:, None] - t[None]) ** p).sum(2) ** (1 / p)
        want = [(i, k + 1, int(j)) for i in range(9) for k, j in enumerate(np.lexsort((np.arange(40), d[i]))[:4])]
        assert got == want


def test_clone_and_params():
    m = make_pipeline(StandardScaler(with_mean=False), Ridge(3.0))
    c = clone(m)
    assert c is not m and c["ridge"].alpha == 3.0 and c["standardscaler"].with_mean is False
    with pytest.raises(TypeError):
        clone(object())
    with pytest.raises(ValueError, match="Invalid parameter"):
        Ridge().set_params(beta=1)


def test_streaming_partial_fit(spark, tmp_path):
    from millrace.sources.tables import read, read_stream, write
    from millrace.streaming.partial import PartialFit, windowed_stats

    data = [(i, float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(data, "id long, v double")
    for k in range(3):
        write(df.filter(f"id % 3 = {k}").coalesce(1), str(tmp_path / "in"), mode="append")
    sink = PartialFit(StandardScaler(), ["v"])
    sink.start(read_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "ck")).awaitTermination()
    whole = StandardScaler().fit(df, ["v"])
    np.testing.assert_allclose(sink.estimator.mean_, whole.mean_)
    np.testing.assert_allclose(sink.estimator.var_, whole.var_)
    sink(df, 0)  # a replayed batch changes nothing
    assert sink.estimator.n_samples_seen_ == 60
    timed = df.selectExpr("timestamp_seconds(id) as ts", "v")
    write(timed.coalesce(1), str(tmp_path / "timed"))
    stats = windowed_stats(read_stream(spark, str(tmp_path / "timed"), timed.schema), "ts", "v", "20 seconds", "1 minute")
    q = stats.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("stats").collect()) == [20, 20, 20]
    for fmt in ("csv", "json", "orc"):
        write(df, str(tmp_path / fmt), fmt)
        assert read(spark, str(tmp_path / fmt), fmt, "id long, v double").count() == 60
    with pytest.raises(ValueError, match="schema"):
        read(spark, "x", "csv")


def test_streaming_state_outlives_the_driver(spark, tmp_path):
    from millrace.streaming.partial import PartialFit

    rows = [spark.createDataFrame([(float(v),) for v in vs], "v double") for vs in ((1, 2), (4, 8), (16,))]
    first = PartialFit(StandardScaler(), ["v"], state=str(tmp_path / "state"))
    first(rows[0], 0)
    first(rows[1], 1)
    again = PartialFit(StandardScaler(), ["v"], state=str(tmp_path / "state"))
    again(rows[1], 1)  # replayed after the restart
    again(rows[2], 2)
    assert again.estimator.mean_[0] == pytest.approx(31 / 5) and again.estimator.n_samples_seen_ == 5


def test_clone_of_containers():
    lasso = Lasso(alpha=2.0)
    got = clone({"a": lasso, "b": [lasso, (lasso,)]})
    assert got["a"] is not lasso and got["a"].alpha == 2.0 and got["b"][1][0].alpha == 2.0 and got["b"][0] is not lasso
    with pytest.raises(TypeError):
        clone({"a": 1})
    assert clone({"a": [1, 2]}, safe=False) == {"a": [1, 2]}
