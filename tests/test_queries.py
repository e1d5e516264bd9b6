"""Registered queries against their own SQL in DuckDB, value by value."""

import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
CHECKED = [
    "minmax_clip", "robust_edges", "imputer_empty_kept", "imputer_empty_dropped", "imputer_sentinel", "imputer_float", "category_lookup",
    "ordinal_stated", "ordinal_missing", "onehot_drop_binary", "onehot_drop_each", "onehot_stated", "multioutput", "scorers",
    "column_transformer_selectors", "feature_names", "column_transformer_coo",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.filterwarnings("ignore:Skipping features")
@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == names
    own = sorted(map(tuple, df.select(*[f"`{n}`" for n in names]).collect()))
    other = sorted(found.select(*[f'"{n}"' for n in names]).fetchall())
    assert len(own) == len(other) > 0
    assert all(close(x, y) for a, b in zip(own, other, strict=True) for x, y in zip(a, b, strict=True))


def test_sparse_output_is_decided_by_the_share_of_values(spark):
    from millrace.operators.compose import ColumnTransformer
    from millrace.operators.encode import OneHotEncoder
    from millrace.operators.scale import MaxAbsScaler

    df = spark.createDataFrame([(i, f"c{i}", float(i)) for i in range(10)], "id int, k string, x double")
    one = lambda branches, **more: ColumnTransformer(branches, keep=["id"], **more).fit(df)
    assert one([("k", OneHotEncoder(), ["k"])]).sparse_output(df)
    assert not one([("k", OneHotEncoder(), ["k"])], sparse_threshold=0.1).sparse_output(df)
    assert not one([("k", OneHotEncoder(sparse_output=False), ["k"])]).sparse_output(df)
    assert not one([("x", MaxAbsScaler(), ["x"])]).sparse_output(df)
    assert not one([("k", OneHotEncoder(), ["k"])]).sparse_output(df.limit(0))
    both = one([("k", OneHotEncoder(), ["k"]), ("x", MaxAbsScaler(), ["x"])])
    cells = {(r["row"], r["col"]): r["value"] for r in both.to_coo(df, "id").collect()}
    assert cells == {(i, i): 1.0 for i in range(10)} | {(i, 10): i / 9 for i in range(1, 10)}
    with pytest.raises(ValueError, match="kept"):
        both.to_coo(df, "x")
