import pytest

import millrace.operators as op
from millrace.functions.validate import check_frame, check_labelled


def test_check_frame(spark):
    df = spark.createDataFrame([(1.0, -2.0, "a"), (None, float("inf"), "b")], "x double, y double, s string")
    assert check_frame(df, ["x"], finite="allow-nan") == ["x"]
    with pytest.raises(ValueError, match="NaN"):
        check_frame(df, ["x"])
    with pytest.raises(ValueError, match="infinity"):
        check_frame(df, ["y"], finite="allow-nan")
    with pytest.raises(ValueError, match="Negative"):
        check_frame(df, ["y"], finite=False, non_negative=True)
    with pytest.raises(ValueError, match="not numeric"):
        check_frame(df)
    with pytest.raises(ValueError, match="minimum of 3"):
        check_frame(df, ["x"], finite=False, min_rows=3)
    with pytest.raises(ValueError, match="no such columns"):
        check_frame(df, ["z"])
    assert check_labelled(df.filter("x = 1"), ["x"], "s") == (["x"], "s")
    with pytest.raises(ValueError, match="label"):
        check_labelled(df, ["x"], "t")


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1.0, "u"), (3.0, "v")], "`a.b` double, k string")
    s = op.StandardScaler().fit(df, ["a.b"])
    assert [r[0] for r in s.transform(df).collect()] == [-1.0, 1.0]


def test_everything_named_is_there():
    assert all(hasattr(op, n) for n in op.__all__)


def test_transform_is_lazy_and_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1.0, 2.0, "x")], "a double, b double, c string").write.parquet(path)
    df = spark.read.parquet(path)
    out = op.StandardScaler().fit(df, ["a"]).transform(df).select("a")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:double>" in plan and "Exchange" not in plan
