import numpy as np
import pytest

from millrace.operators.encode import LabelEncoder, OneHotEncoder, OrdinalEncoder, discover, encode_categories, infrequent
from millrace.operators.sparse import SparseMaxAbsScaler, SparseStandardScaler, validate


def column(df, name):
    return [r[name] for r in df.collect()]


def labels(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"y {kind}")


def test_label_encoder(spark):
    df = labels(spark, [10, -2, 10, 3], "long")
    e = LabelEncoder().fit(df, "y")
    assert e.classes_.tolist() == [-2, 3, 10]
    assert column(e.transform(df), "y") == [2, 0, 2, 1]
    assert column(e.inverse_transform(e.transform(df)), "y") == [10, -2, 10, 3]
    text = labels(spark, ["東京", "café", "東京", "å"])
    e = LabelEncoder().fit(text, "y")
    assert e.classes_.tolist() == sorted(["東京", "café", "å"])
    assert column(e.inverse_transform(e.transform(text)), "y") == ["東京", "café", "東京", "å"]


def test_label_encoder_big_numbers(spark):
    df = labels(spark, [2**53, 2**53 + 1], "long")
    assert column(LabelEncoder().fit_transform(df, "y"), "y") == [0, 1]


def test_label_encoder_errors(spark):
    e = LabelEncoder().fit(labels(spark, ["a", "b"]), "y")
    with pytest.raises(Exception, match="unknown label: c"):
        e.transform(labels(spark, ["c"])).collect()
    with pytest.raises(TypeError):
        e.transform(labels(spark, [1], "long"))
    with pytest.raises(Exception, match="outside the valid range"):
        e.inverse_transform(labels(spark, [2], "long")).collect()
    with pytest.raises(TypeError):
        e.inverse_transform(labels(spark, [0.5], "double"))


def test_categories(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (2.0, "b")], "x0 double, x1 string")
    found = discover(df, ["x0", "x1"])
    assert [f.values for f in found] == [[1.0, 2.0, None], ["a", "b", None]]
    other = spark.createDataFrame([(2.0, "z"), (None, "a")], "x0 double, x1 string")
    assert [tuple(r) for r in encode_categories(other, found).collect()] == [(1, -1), (2, 0)]


@pytest.mark.parametrize(("kw", "want"), [({"min_frequency": 2}, [0, 3]), ({"min_frequency": 0.3}, [0, 1, 3]), ({"max_categories": 3}, [0, 3]), ({"max_categories": 4}, [0]), ({"max_categories": 5}, [])])
def test_infrequent(kw, want):
    # a once, b twice, c three times, d once, of eight rows
    assert infrequent([1, 2, 3, 1], 8, kw.get("min_frequency"), kw.get("max_categories")) == want


def test_ordinal(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), ("c",), ("d",), (None,)], "x0 string")
    e = OrdinalEncoder(min_frequency=2).fit(df)
    assert column(e.transform(df), "x0") == [2, 0, 0, 1, 1, 1, 2, None]
    assert column(e.inverse_transform(e.transform(df)), "x0") == ["infrequent_sklearn", "b", "b", "c", "c", "c", "infrequent_sklearn", None]
    shared = OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1, encoded_missing_value=-1)
    shared.fit(spark.createDataFrame([("a",), (None,)], "x0 string"))
    assert column(shared.transform(spark.createDataFrame([("other",), (None,)], "x0 string")), "x0") == [-1, -1]
    with pytest.raises(TypeError):
        OrdinalEncoder(handle_unknown="use_encoded_value").fit(df)
    with pytest.raises(ValueError, match="already used"):
        OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=1).fit(df)


def test_one_hot_options(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 1), (None, 2)], "left string, right long")
    for kw in ({}, {"drop": "first"}, {"drop": "if_binary"}, {"drop": ["b", 2]}):
        e = OneHotEncoder(**kw).fit(df)
        assert [tuple(r) for r in e.inverse_transform(e.transform(df)).collect()] == [tuple(r) for r in df.collect()]
    names = OneHotEncoder(feature_name_combiner=lambda f, c: f"{f}={c}").fit(df).get_feature_names_out()
    assert names[0] == "left=a" and names[-1] == "right=3"
    assert OneHotEncoder(drop=["b", 2]).fit(df).drop_idx_.tolist() == [1, 1]
    with pytest.raises(ValueError, match="not found"):
        OneHotEncoder(drop=["z", 2]).fit(df)


def test_one_hot_unknown(spark):
    fit = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "x0 string")
    new = spark.createDataFrame([("a",), ("other",)], "x0 string")
    out = OneHotEncoder(handle_unknown="ignore").fit(fit).transform(new).collect()
    assert tuple(out[1]) == (0, 0, 0)
    for how in ("infrequent_if_exist", "warn"):
        out = OneHotEncoder(handle_unknown=how, min_frequency=2).fit(fit).transform(new).collect()
        assert [tuple(r) for r in out] == [(1, 0), (0, 1)]
    with pytest.raises(Exception, match="unknown categories"):
        OneHotEncoder().fit(fit).transform(new).collect()


def test_one_hot_coordinates_agree_with_columns(spark):
    df = spark.createDataFrame([(i, "abcd"[i % 4], i % 3) for i in range(12)], "id long, x string, y long")
    for drop in (None, "first"):
        e = OneHotEncoder(drop=drop).fit(df, ["x", "y"])
        wide = {r[0]: tuple(r)[1:] for r in e.transform(df).collect()}
        cells = {(r["row"], r["col"]) for r in e.to_coo(df, "id").collect()}
        assert cells == {(i, j) for i, v in wide.items() for j, x in enumerate(v) if x}


def test_large_dictionary_is_joined(spark, monkeypatch):
    from millrace.operators import encode

    df = labels(spark, [f"k{i % 9}" for i in range(30)])
    plain = column(LabelEncoder().fit_transform(df, "y"), "y")
    monkeypatch.setattr(encode, "MAP_ENTRIES", 3)
    assert sorted(column(LabelEncoder().fit_transform(df, "y"), "y")) == sorted(plain)


def test_sparse(spark):
    dense = np.array([[0, 2, 0], [4, 0, np.nan], [0, -2, 0]])
    cells = [(i, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v != 0]
    coo = spark.createDataFrame(cells, "row long, col long, value double")
    s = SparseStandardScaler().fit(coo, (3, 3))
    np.testing.assert_allclose(s.var_, np.nanvar(dense, axis=0), rtol=1e-12)
    back = {(r["row"], r["col"]): r["value"] for r in s.inverse_transform(s.transform(coo)).collect()}
    assert back[(1, 0)] == pytest.approx(4) and back[(2, 1)] == pytest.approx(-2)
    assert SparseMaxAbsScaler().fit(coo, (3, 3)).max_abs_.tolist() == [4, 2, 0]
    with pytest.raises(ValueError, match="center"):
        SparseStandardScaler(with_mean=True)
    with pytest.raises(ValueError, match="bounds"):
        validate(coo, (2, 3))
