"""Registered queries: each applies one operator to a table, beside the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, sparse, split
from ..operators.compose import ColumnTransformer, make_column_transformer, make_pipeline
from ..operators.encode import LabelEncoder, OneHotEncoder, OrdinalEncoder, discover, encode_categories
from ..operators.impute import SimpleImputer
from ..operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from ..operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from ..operators.scale import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler, normalize_array
from ..operators.validate import cross_val_score
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[r6(n).alias(n) if n in names else F.col(n) for n in df.columns])


LINE = ["l_orderkey", "l_partkey", "l_linenumber"]
LINE_SQL = "l_orderkey, l_partkey, l_linenumber"


def _line(spark, d, *more):
    return read_table(spark, d, "lineitem").select(*LINE, *more)


# Scalers


@query(
    "with s as (select avg(l_quantity) m, stddev_pop(l_quantity) sd, avg(l_extendedprice) pm, stddev_pop(l_extendedprice) psd from lineitem)"
    f" select {LINE_SQL}, round((l_quantity-m)/sd, 6) l_quantity, round((l_extendedprice-pm)/psd, 6) l_extendedprice from lineitem cross join s"
)
def standard_scaler_transform(spark, d):
    df, x = _line(spark, d, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]
    return rounded(StandardScaler().fit(df, x).transform(df), x)


@query(
    "select count(l_quantity) n, round(avg(l_quantity), 6) mean_q, round(var_pop(l_quantity), 6) var_q, round(stddev_pop(l_quantity), 6) scale_q,"
    " round(avg(l_discount), 6) mean_d, round(var_pop(l_discount), 6) var_d from lineitem"
)
def standard_scaler_fit(spark, d):
    s = StandardScaler().fit(read_table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    row = one_row(spark, n=s.n_samples_seen_, mean_q=float(s.mean_[0]), var_q=float(s.var_[0]), scale_q=float(s.scale_[0]), mean_d=float(s.mean_[1]), var_d=float(s.var_[1]))
    return rounded(row.withColumn("n", F.col("n").cast("long")), row.columns[1:])


@query(f"select {LINE_SQL}, round(l_quantity, 6) l_quantity from lineitem")
def standard_scaler_inverse(spark, d):
    df = _line(spark, d, "l_quantity")
    s = StandardScaler().fit(df, ["l_quantity"])
    return rounded(s.inverse_transform(s.transform(df)), ["l_quantity"])


@query(f"with s as (select stddev_pop(l_quantity) sd from lineitem) select {LINE_SQL}, round(l_quantity/sd, 6) l_quantity from lineitem cross join s")
def standard_scaler_no_mean(spark, d):
    df = _line(spark, d, "l_quantity")
    return rounded(StandardScaler(with_mean=False).fit(df, ["l_quantity"]).transform(df), ["l_quantity"])


@query(f"with s as (select avg(l_quantity) m from lineitem) select {LINE_SQL}, round(l_quantity-m, 6) l_quantity from lineitem cross join s")
def standard_scaler_no_std(spark, d):
    df = _line(spark, d, "l_quantity")
    return rounded(StandardScaler(with_std=False).fit(df, ["l_quantity"]).transform(df), ["l_quantity"])


@query("select count(*) n, round(avg(l_extendedprice), 4) mean, round(stddev_pop(l_extendedprice), 4) scale from lineitem")
def standard_scaler_partial_fit(spark, d):
    df, s = read_table(spark, d, "lineitem"), StandardScaler()
    for flag in ("A", "N", "R"):
        s.partial_fit(df.filter(F.col("l_returnflag") == flag), ["l_extendedprice"])
    row = one_row(spark, n=int(s.n_samples_seen_), mean=float(s.mean_[0]), scale=float(s.scale_[0]))
    return row.select(F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


@query(
    "with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)"
    " select o_orderkey, round((o_totalprice-lo)*(3.0::DOUBLE/(hi-lo))-1, 6) o_totalprice from orders cross join s"
)
def minmax_transform(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(MinMaxScaler((-1, 2)).fit(df, ["o_totalprice"]).transform(df), ["o_totalprice"])


@query(
    "with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders where o_orderstatus = 'F')"
    " select o_orderkey, round(least(greatest((o_totalprice-lo)/(hi-lo), 0), 1), 6) o_totalprice from orders cross join s"
)
def minmax_clip(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = MinMaxScaler(clip=True).fit(df.filter("o_orderstatus = 'F'"), ["o_totalprice"])
    return rounded(s.transform(df.drop("o_orderstatus")), ["o_totalprice"])


@query("select min(o_totalprice) data_min, max(o_totalprice) data_max, count(*) n from orders")
def minmax_partial_fit(spark, d):
    df, s = read_table(spark, d, "orders"), MinMaxScaler()
    for status in ("F", "O", "P"):
        s.partial_fit(df.filter(F.col("o_orderstatus") == status), ["o_totalprice"])
    row = one_row(spark, data_min=float(s.data_min_[0]), data_max=float(s.data_max_[0]), n=s.n_samples_seen_)
    return row.withColumn("n", F.col("n").cast("long"))


@query("select o_orderkey, round(o_totalprice, 4) o_totalprice from orders")
def minmax_inverse(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = MinMaxScaler().fit(df, ["o_totalprice"])
    return s.inverse_transform(s.transform(df)).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("with s as (select max(abs(p_retailprice)) m, max(abs(p_size)) k from part) select p_partkey, round(p_retailprice/m, 6) p_retailprice, round(p_size/k, 6) p_size from part cross join s")
def maxabs_transform(spark, d):
    df, x = read_table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]
    return rounded(MaxAbsScaler().fit(df, x).transform(df), x)


@query("select max(abs(s_acctbal)) max_abs, count(*) n from supplier")
def maxabs_partial_fit(spark, d):
    df, s = read_table(spark, d, "supplier"), MaxAbsScaler()
    for i in range(3):
        s.partial_fit(df.filter(F.col("s_suppkey") % 3 == i), ["s_acctbal"])
    return one_row(spark, max_abs=float(s.max_abs_[0]), n=s.n_samples_seen_).withColumn("n", F.col("n").cast("long"))


@query("select round(quantile_cont(l_quantity, 0.5), 6) center_q, round(quantile_cont(l_quantity, 0.75)-quantile_cont(l_quantity, 0.25), 6) scale_q, round(quantile_cont(l_extendedprice, 0.5), 6) center_p, round(quantile_cont(l_extendedprice, 0.75)-quantile_cont(l_extendedprice, 0.25), 6) scale_p from lineitem")
def robust_fit(spark, d):
    s = RobustScaler().fit(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    row = one_row(spark, center_q=float(s.center_[0]), scale_q=float(s.scale_[0]), center_p=float(s.center_[1]), scale_p=float(s.scale_[1]))
    return rounded(row, row.columns)


@query(
    "with s as (select quantile_cont(l_extendedprice, 0.5) m, quantile_cont(l_extendedprice, 0.9)-quantile_cont(l_extendedprice, 0.1) w from lineitem)"
    f" select {LINE_SQL}, round((l_extendedprice-m)/w, 6) l_extendedprice from lineitem cross join s"
)
def robust_transform(spark, d):
    df = _line(spark, d, "l_extendedprice")
    return rounded(RobustScaler(quantile_range=(10.0, 90.0)).fit(df, ["l_extendedprice"]).transform(df), ["l_extendedprice"])


@query(
    "with s as (select quantile_cont(l_quantity, 0.5) m, (quantile_cont(l_quantity, 0.75)-quantile_cont(l_quantity, 0.25))/1.3489795003921634 w from lineitem)"
    f" select {LINE_SQL}, round((l_quantity-m)/w, 6) l_quantity from lineitem cross join s"
)
def robust_unit_variance(spark, d):
    df = _line(spark, d, "l_quantity")
    return rounded(RobustScaler(unit_variance=True).fit(df, ["l_quantity"]).transform(df), ["l_quantity"])


@query("select min(l_tax) low, max(l_tax) - min(l_tax) whole_width, quantile_cont(l_tax, 0.5) center, 1.0::DOUBLE no_width from lineitem")
def robust_edges(spark, d):
    df = read_table(spark, d, "lineitem").select("l_tax")
    whole = RobustScaler(quantile_range=(0.0, 100.0)).fit(df, ["l_tax"])
    none = RobustScaler(quantile_range=(50.0, 50.0)).fit(df, ["l_tax"])
    low = MinMaxScaler().fit(df, ["l_tax"]).data_min_[0]
    return one_row(spark, low=float(low), whole_width=float(whole.scale_[0]), center=float(none.center_[0]), no_width=float(none.scale_[0]))


def _norm(norm: str):
    def run(spark, d):
        df, x = read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]
        return rounded(Normalizer(norm).fit(df, x).transform(df), x)

    run.__name__ = f"normalizer_{norm}"
    return run


for _n, _sql in (("l1", "abs(p_size)+abs(p_retailprice)"), ("l2", "sqrt(p_size*p_size+p_retailprice*p_retailprice)"), ("max", "greatest(abs(p_size), abs(p_retailprice))")):
    query(f"select p_partkey, round(p_size/({_sql}), 6) p_size, round(p_retailprice/({_sql}), 6) p_retailprice from part")(_norm(_n))


@query("select vec_id, i, round(x / sqrt(list_sum(list_transform(e, lambda y: y*y))), 6) v from (select vec_id, embedding::DOUBLE[] e, unnest(embedding::DOUBLE[]) x, unnest(range(len(embedding))) i from embeddings)")
def normalizer_array(spark, d):
    df = read_table(spark, d, "embeddings")
    return df.select("vec_id", F.posexplode(normalize_array("embedding")).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6("x").alias("v"))


# Imputation: every seventh value is taken away first.

GAPS = "(select event_id, case when event_id % 7 = 0 then null else value end v, case when event_id % 5 = 0 then null else event_type end k from events)"


def _gaps(spark, d) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("k"))


def _imputed(strategy: str):
    def run(spark, d):
        df = _gaps(spark, d).select("event_id", "v")
        return rounded(SimpleImputer(strategy=strategy).fit(df, ["v"]).transform(df), ["v"])

    run.__name__ = f"imputer_{strategy}"
    return run


for _n, _sql in (("mean", "avg(v)"), ("median", "quantile_cont(v, 0.5)")):
    query(f"with g as {GAPS}, s as (select {_sql} m from g) select event_id, round(coalesce(v, m), 6) v from g cross join s")(_imputed(_n))


@query(f"with g as {GAPS}, s as (select k m from g where k is not null group by k order by count(*) desc, k limit 1) select event_id, coalesce(k, m) k from g cross join s")
def imputer_most_frequent(spark, d):
    df = _gaps(spark, d).select("event_id", "k")
    return SimpleImputer(strategy="most_frequent").fit(df, ["k"]).transform(df)


@query(f"with g as {GAPS} select event_id, coalesce(v, -1) v, coalesce(k, 'missing_value') k from g")
def imputer_constant(spark, d):
    df = _gaps(spark, d)
    numbers = SimpleImputer(strategy="constant", fill_value=-1).fit(df, ["v"]).transform(df)
    return SimpleImputer(strategy="constant").fit(numbers, ["k"]).transform(numbers)


@query(f"with g as {GAPS}, s as (select avg(v) m from g) select event_id, round(coalesce(v, m), 6) v, (v is null)::int::double missingindicator_v from g cross join s")
def imputer_indicator(spark, d):
    df = _gaps(spark, d).select("event_id", "v")
    return rounded(SimpleImputer(add_indicator=True).fit(df, ["v"]).transform(df), ["v"])


@query(f"with g as {GAPS} select event_id, round(v, 6) v from g")
def imputer_inverse(spark, d):
    df = _gaps(spark, d).select("event_id", "v")
    s = SimpleImputer(add_indicator=True).fit(df, ["v"])
    return rounded(s.inverse_transform(s.transform(df)), ["v"])


@query(f"with g as {GAPS}, s as (select max(v) m from g) select event_id, coalesce(v, m) v from g cross join s")
def imputer_callable(spark, d):
    df = _gaps(spark, d).select("event_id", "v")
    return SimpleImputer(strategy=F.max).fit(df, ["v"]).transform(df)


@query(f"with g as {GAPS}, s as (select avg(v) m from g) select event_id, round(coalesce(v, m), 6) v, 0.0::DOUBLE none from g cross join s")
def imputer_empty_kept(spark, d):
    df = _gaps(spark, d).select("event_id", "v", F.lit(None).cast("double").alias("none"))
    return rounded(SimpleImputer(keep_empty_features=True).fit(df, ["v", "none"]).transform(df), ["v"])


@query(f"with g as {GAPS}, s as (select quantile_cont(v, 0.5) m from g) select event_id, round(coalesce(v, m), 6) v from g cross join s")
def imputer_empty_dropped(spark, d):
    df = _gaps(spark, d).select("event_id", "v", F.lit(None).cast("double").alias("none"))
    return rounded(SimpleImputer(strategy="median").fit(df, ["v", "none"]).transform(df), ["v"])


@query(f"with g as {GAPS}, s as (select avg(v) m from g) select event_id, round(coalesce(v, m), 6) v, (v is null)::int::double missingindicator_v from g cross join s")
def imputer_sentinel(spark, d):
    df = _gaps(spark, d).select("event_id", F.coalesce("v", F.lit(-1.0)).alias("v"))
    return rounded(SimpleImputer(missing_values=-1, add_indicator=True).fit(df, ["v"]).transform(df), ["v"])


@query(f"with g as {GAPS}, s as (select max(v) m from g) select event_id, coalesce(v::float, m::float) v from g cross join s")
def imputer_float(spark, d):
    df = _gaps(spark, d).select("event_id", F.col("v").cast("float").alias("v"))
    return SimpleImputer(strategy=F.max).fit(df, ["v"]).transform(df)


# Encoders


@query("select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::bigint c_mktsegment from customer")
def label_encode(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return LabelEncoder().fit_transform(df, "c_mktsegment")


@query("select c_custkey, c_mktsegment from customer")
def label_inverse(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    e = LabelEncoder().fit(df, "c_mktsegment")
    return e.inverse_transform(e.transform(df))


@query("select 'event_type' feature, event_type category, count(*) n from events group by event_type union all select 'user_id', user_id::varchar, count(*) from events group by user_id")
def category_discovery(spark, d):
    found = discover(read_table(spark, d, "events"), ["event_type", "user_id"])
    return spark.createDataFrame([(f.name, str(v), k) for f in found for v, k in zip(f.values, f.counts, strict=True)], "feature string, category string, n long")


@query("select p_partkey, (case when b is null then -1 else b end)::bigint p_brand from (select p_partkey, p_brand from part) p left join (select p_brand x, dense_rank() over (order by p_brand) - 1 b from (select distinct p_brand from part where p_brand < 'Brand#3')) k on p_brand = x")
def category_lookup(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return encode_categories(df, discover(df.filter("p_brand < 'Brand#3'"), ["p_brand"]))


@query("select p_partkey, (dense_rank() over (order by p_type) - 1)::double p_type, (dense_rank() over (order by p_brand) - 1)::double p_brand from part")
def ordinal_encode(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return OrdinalEncoder().fit(df, ["p_type", "p_brand"]).transform(df)


@query(
    "with k as (select p_brand, count(*) n, row_number() over (order by p_brand) i from part group by p_brand), r as (select *, row_number() over (order by n desc, i desc) place from k),"
    " f as (select p_brand, row_number() over (order by i) - 1 code from r where place <= 9) select p_partkey, coalesce(code, 9)::double p_brand from part left join f using (p_brand)"
)
def ordinal_infrequent(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return OrdinalEncoder(max_categories=10).fit(df, ["p_brand"]).transform(df)


@query("with f as (select event_type, row_number() over (order by event_type) - 1 code from (select distinct event_type from events where event_type <> 'error')) select event_id, coalesce(code, -1)::double event_type from events left join f using (event_type)")
def ordinal_unknown(spark, d):
    df = read_table(spark, d, "events").select("event_id", "event_type")
    e = OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1).fit(df.filter("event_type <> 'error'"), ["event_type"])
    return e.transform(df)


@query("select p_partkey, p_type from part")
def ordinal_inverse(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", "p_type")
    e = OrdinalEncoder().fit(df, ["p_type"])
    return e.inverse_transform(e.transform(df))


@query("select o_orderkey, (case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end)::double o_orderstatus from orders")
def ordinal_stated(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return OrdinalEncoder(categories=[["P", "O", "F"]]).fit(df, ["o_orderstatus"]).transform(df)


@query(f"with g as {GAPS}, f as (select k, row_number() over (order by k) - 1 code from (select distinct k from g where k is not null)) select event_id, coalesce(code, -2)::int k from g left join f using (k)")
def ordinal_missing(spark, d):
    df = _gaps(spark, d).select("event_id", "k")
    return OrdinalEncoder(dtype="int", encoded_missing_value=-2).fit(df, ["k"]).transform(df)


def _cases(column: str, values: list[str], skip: str = "") -> str:
    return ", ".join(f"""({column} = '{v}')::int::double "{column}_{v}\"""" for v in values if v != skip)


STATUS = ["F", "O", "P"]


@query(f"select o_orderkey, {_cases('o_orderstatus', STATUS)} from orders")
def onehot(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return OneHotEncoder().fit(df, ["o_orderstatus"]).transform(df)


@query(f"select o_orderkey, {_cases('o_orderstatus', STATUS, 'F')} from orders")
def onehot_drop_first(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return OneHotEncoder(drop="first").fit(df, ["o_orderstatus"]).transform(df)


@query(f"select o_orderkey, {_cases('o_orderstatus', STATUS[:2])} from orders")
def onehot_ignore_unknown(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return OneHotEncoder(handle_unknown="ignore").fit(df.filter("o_orderstatus <> 'P'"), ["o_orderstatus"]).transform(df)


@query(
    "with k as (select p_brand, count(*) n, row_number() over (order by p_brand) i from part group by p_brand), r as (select *, row_number() over (order by n desc, i desc) place from k),"
    " f as (select p_brand, row_number() over (order by i) - 1 code from r where place <= 4) select p_partkey as row, coalesce(code, 4)::bigint col, 1.0::double as value from part left join f using (p_brand)"
)
def onehot_infrequent_coo(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return OneHotEncoder(max_categories=5).fit(df, ["p_brand"]).to_coo(df, "p_partkey")


@query(f"select {LINE_SQL}, {_cases('l_linestatus', ['F', 'O'], 'F')}, {_cases('l_returnflag', ['A', 'N', 'R'])} from lineitem")
def onehot_drop_binary(spark, d):
    df = _line(spark, d, "l_linestatus", "l_returnflag")
    return OneHotEncoder(drop="if_binary").fit(df, ["l_linestatus", "l_returnflag"]).transform(df)


@query(f"select {LINE_SQL}, {_cases('l_linestatus', ['F', 'O'], 'O')}, {_cases('l_returnflag', ['A', 'N', 'R'], 'N')} from lineitem")
def onehot_drop_each(spark, d):
    df = _line(spark, d, "l_linestatus", "l_returnflag")
    return OneHotEncoder(drop=["O", "N"]).fit(df, ["l_linestatus", "l_returnflag"]).transform(df)


@query(f"select o_orderkey, {_cases('o_orderstatus', ['P', 'O', 'F', 'X'])} from orders")
def onehot_stated(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return OneHotEncoder(categories=[["P", "O", "F", "X"]]).fit(df, ["o_orderstatus"]).transform(df)


@query("select o_orderkey, o_orderstatus from orders")
def onehot_inverse(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    e = OneHotEncoder().fit(df, ["o_orderstatus"])
    return e.inverse_transform(e.transform(df))


# Sparse coordinates: quantities over 25 of each line, by line number.

COO = "(select l_orderkey as row, l_linenumber - 1 col, sum(l_quantity) as value from lineitem where l_quantity > 25 group by all)"


def _coo(spark, d) -> tuple[DataFrame, tuple[int, int]]:
    df = read_table(spark, d, "lineitem").filter("l_quantity > 25")
    shape = df.agg(F.max("l_orderkey"), F.max("l_linenumber")).first()
    return df.select(F.col("l_orderkey").alias("row"), (F.col("l_linenumber") - 1).cast("long").alias("col"), F.col("l_quantity").alias("value")), (shape[0] + 1, shape[1])


@query(f"with c as {COO} select row, col::bigint col, round(value, 6) as value from c")
def sparse_canonical(spark, d):
    return rounded(sparse.canonical(_coo(spark, d)[0]), ["value"])


@query(f"with c as {COO}, n as (select max(l_orderkey) + 1 n from lineitem where l_quantity > 25), s as (select col, sqrt(sum(value*value)/max(n) - (sum(value)/max(n))*(sum(value)/max(n))) sd from c cross join n group by col) select row, col::bigint col, round(value/sd, 6) as value from c join s using (col)")
def sparse_standard_scaler(spark, d):
    coo, shape = _coo(spark, d)
    return rounded(sparse.SparseStandardScaler().fit(coo, shape).transform(coo), ["value"])


@query(f"with c as {COO}, s as (select col, max(abs(value)) m from c group by col) select row, col::bigint col, round(value/m, 6) as value from c join s using (col)")
def sparse_maxabs_scaler(spark, d):
    coo, shape = _coo(spark, d)
    return rounded(sparse.SparseMaxAbsScaler().fit(coo, shape).transform(coo), ["value"])


# Classification metrics: quality against "not toxic", weight doc_id % 3 + 1.

PAIR = "(select quality t, 1 - toxic p, (doc_id % 3 + 1)::double w from labels)"


def _pair(spark, d) -> DataFrame:
    return read_table(spark, d, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p"), (F.col("doc_id") % 3 + 1).cast("double").alias("w"))


@query(f"select round(avg((t = p)::int), 6) plain, round(sum(case when t = p then w else 0 end)/sum(w), 6) weighted, sum((t = p)::int)::double hits from {PAIR}")
def accuracy(spark, d):
    df = _pair(spark, d)
    row = one_row(spark, plain=metrics.accuracy_score(df, "t", "p"), weighted=metrics.accuracy_score(df, "t", "p", weight="w"), hits=metrics.accuracy_score(df, "t", "p", normalize=False))
    return rounded(row, ["plain", "weighted"])


GRID = f"(select i::bigint t, j::bigint p, sum((t = i and p = j)::int)::bigint n, sum(case when t = i and p = j then w else 0 end) w from {PAIR} cross join (values (0), (1)) a(i) cross join (values (0), (1)) b(j) group by all)"


def _cells(spark, m: np.ndarray, kind: str) -> DataFrame:
    rows = [(i, j, m[i, j].item()) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, f"t long, p long, n {kind}")


@query(f"select t, p, n from {GRID}")
def confusion_matrix(spark, d):
    return _cells(spark, metrics.confusion_matrix(_pair(spark, d), "t", "p", labels=[0, 1]), "long")


@query(f"select t, p, round(coalesce(w / nullif(sum(w) over (partition by t), 0), 0), 6) n from {GRID}")
def confusion_matrix_normalized(spark, d):
    m = metrics.confusion_matrix(_pair(spark, d), "t", "p", labels=[0, 1], weight="w", normalize="true")
    return rounded(_cells(spark, m, "double"), ["n"])


CLASS = f"(select c, sum((t = c and p = c)::int)::double tp, sum((p = c)::int)::double pr, sum((t = c)::int)::double ac from {PAIR} cross join (values (0), (1)) k(c) group by c)"
_PRF = {"precision": ("tp", "pr"), "recall": ("tp", "ac"), "f1": ("2*tp", "ac+pr")}


def _averages(what: str):
    score = {"precision": metrics.precision_score, "recall": metrics.recall_score, "f1": metrics.f1_score}[what]

    def run(spark, d):
        df = _pair(spark, d).cache()
        row = one_row(spark, **{a: float(score(df, "t", "p", average=a, zero_division=0)) for a in ("binary", "micro", "macro", "weighted")})
        df.unpersist()
        return rounded(row, row.columns)

    run.__name__ = what
    return run


for _n, (_num, _den) in _PRF.items():
    query(
        f"with k as (select *, coalesce({_num} / nullif({_den}, 0), 0) s from {CLASS}) select round(max(case when c = 1 then s end), 6) \"binary\","
        f" round(sum({_num}) / sum({_den}), 6) micro, round(avg(s), 6) macro, round(sum(s*ac)/sum(ac), 6) weighted from k"
    )(_averages(_n))


# Regression metrics: price against 2000 * quantity, and tax against discount.

PRED = "(select l_extendedprice y0, 2000*l_quantity p0, l_tax y1, l_discount p1, l_linenumber::double w from lineitem)"


def _pred(spark, d) -> DataFrame:
    return read_table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("y0"), (2000 * F.col("l_quantity")).alias("p0"), F.col("l_tax").alias("y1"), F.col("l_discount").alias("p1"), F.col("l_linenumber").cast("double").alias("w")
    )


@query(f"select round(avg((y0-p0)*(y0-p0))/1e6, 6) mse0, round(sum(w*(y1-p1)*(y1-p1))/sum(w), 6) mse1_weighted from {PRED}")
def mean_squared_error(spark, d):
    df = _pred(spark, d)
    row = one_row(spark, mse0=metrics.mean_squared_error(df, "y0", "p0") / 1e6, mse1_weighted=metrics.mean_squared_error(df, "y1", "p1", weight="w"))
    return rounded(row, row.columns)


@query(f"select round(avg(abs(y0-p0)), 4) mae0, round((avg(abs(y0-p0)) + avg(abs(y1-p1)))/2, 4) uniform from {PRED}")
def mean_absolute_error(spark, d):
    df = _pred(spark, d)
    row = one_row(spark, mae0=metrics.mean_absolute_error(df, "y0", "p0"), uniform=metrics.mean_absolute_error(df, ["y0", "y1"], ["p0", "p1"]))
    return row.select(*[F.round(x, 4).alias(x) for x in row.columns])


@query(f"with m as (select avg(y0) m0, avg(y1) m1 from {PRED}), s as (select sum((y0-p0)*(y0-p0)) e0, sum((y0-m0)*(y0-m0)) v0, sum((y1-p1)*(y1-p1)) e1, sum((y1-m1)*(y1-m1)) v1 from {PRED} cross join m) select round(1-e0/v0, 6) r2_0, round(1-e1/v1, 6) r2_1, round(((1-e0/v0)*v0+(1-e1/v1)*v1)/(v0+v1), 6) variance_weighted from s")
def r2(spark, d):
    df = _pred(spark, d)
    raw = metrics.r2_score(df, ["y0", "y1"], ["p0", "p1"], multioutput="raw_values")
    row = one_row(spark, r2_0=float(raw[0]), r2_1=float(raw[1]), variance_weighted=metrics.r2_score(df, ["y0", "y1"], ["p0", "p1"], multioutput="variance_weighted"))
    return rounded(row, row.columns)


@query(f"select round(avg(abs(y0-p0)), 4) mae0, round(avg(abs(y1-p1)), 6) mae1, round(0.25*avg(abs(y0-p0)) + 0.75*avg(abs(y1-p1)), 4) mae_weighted, round(sqrt(avg((y1-p1)*(y1-p1))), 6) rmse1 from {PRED}")
def multioutput(spark, d):
    df, both = _pred(spark, d), (["y0", "y1"], ["p0", "p1"])
    raw = metrics.mean_absolute_error(df, *both, multioutput="raw_values")
    row = one_row(
        spark, mae0=float(raw[0]), mae1=float(raw[1]), mae_weighted=float(metrics.mean_absolute_error(df, *both, multioutput=[0.25, 0.75])),
        rmse1=float(metrics.mean_squared_error(df, *both, multioutput="raw_values")[1]) ** 0.5,
    )
    return row.select(F.round("mae0", 4).alias("mae0"), r6("mae1").alias("mae1"), F.round("mae_weighted", 4).alias("mae_weighted"), r6("rmse1").alias("rmse1"))


# Splits


@query("with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () n from orders) select o_orderkey, (case when i < (n%7)*(n//7+1) then i//(n//7+1) else n%7 + (i-(n%7)*(n//7+1))//(n//7) end)::int fold from n")
def kfold(spark, d):
    return split.KFold(7).assign(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "with s as (select doc_id, quality + 2*toxic y from labels), k as (select *, row_number() over (partition by y order by doc_id) - 1 j, count(*) over (partition by y) n from s),"
    " st as (select y, sum(c) over (order by y) - c a, c from (select y, count(*) c from s group by y)),"
    " q as (select y, f, (select count(*) from range(a::bigint, (a + c)::bigint) t(x) where x % 4 = f) q from st cross join range(4) g(f)),"
    " e as (select y, f, sum(q) over (partition by y order by f) e from q)"
    " select doc_id, k.y::int y, (select count(*) from e where e.y = k.y and e.e <= k.j)::int fold from k"
)
def stratified_kfold(spark, d):
    df = read_table(spark, d, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("y"))
    return split.StratifiedKFold(4).assign(df, "doc_id", "y")


@query("with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () n from orders) select o_orderkey, i >= floor(n - ceil(n*0.25)) is_test from n")
def train_test_sequential(spark, d):
    train, test = split.train_test_split(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", shuffle=False)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("with n as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 i, count(*) over () n from labels) select doc_id, i < ceil(n*0.25) is_test from n")
def train_test_shuffled(spark, d):
    train, test = split.train_test_split(read_table(spark, d, "labels").select("doc_id"), "doc_id", random_state=42)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


#: Parts of each class by largest remainders: t of the train side, u of the test side.
SHARES = (
    "k as (select toxic, count(*) c from labels group by toxic), n as (select sum(c)::bigint n, ceil(sum(c)*0.3)::bigint test from k),"
    " a as (select toxic, c, n, test, c*(n-test)//n q, row_number() over (order by c*(n-test)%n desc, md5('7:' || toxic)) r, sum(c*(n-test)//n) over () s from k cross join n),"
    " t as (select *, q + (r <= n-test-s)::bigint t from a),"
    " b as (select *, (c-t)*test//test q2, row_number() over (order by (c-t)*test%test desc, md5('7:' || toxic)) r2, sum((c-t)*test//test) over () s2 from t),"
    " u as (select *, q2 + (r2 <= test-s2)::bigint u from b)"
)


@query(f"with {SHARES}, l as (select *, row_number() over (partition by toxic order by md5('7:' || doc_id), doc_id) - 1 i from labels) select doc_id, quality, l.toxic, i < u is_test from l join u on l.toxic = u.toxic")
def train_test_stratified(spark, d):
    df = read_table(spark, d, "labels")
    train, test = split.train_test_split(df, "doc_id", test_size=0.3, random_state=7, stratify="toxic")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("with n as (select o_orderkey, row_number() over (order by md5('3:' || o_orderkey), o_orderkey) - 1 i, count(*) over () n from orders) select o_orderkey, (case when i < (n%7)*(n//7+1) then i//(n//7+1) else n%7 + (i-(n%7)*(n//7+1))//(n//7) end)::int fold from n")
def kfold_shuffled(spark, d):
    return split.KFold(7, shuffle=True, random_state=3).assign(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


# Linear models


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) coef, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 from lineitem")
def linear_regression_1d(spark, d):
    df = read_table(spark, d, "lineitem")
    m = LinearRegression().fit(df, ["l_quantity"], "l_extendedprice")
    row = one_row(spark, coef=float(m.coef_[0]), intercept=float(m.intercept_), r2=m.score(df))
    return row.select(F.round("coef", 4).alias("coef"), F.round("intercept", 4).alias("intercept"), r6("r2").alias("r2"))


MOMENTS = "(select covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_discount, l_discount) e, covar_pop(l_quantity, l_extendedprice) u, covar_pop(l_discount, l_extendedprice) v, count(*) n, avg(l_quantity) mq, avg(l_discount) md, avg(l_extendedprice) mp from lineitem)"


@query(f"with m as {MOMENTS} select round((u*e-v*b)/(a*e-b*b), 3) c0, round((v*a-u*b)/(a*e-b*b), 3) c1 from m")
def linear_regression_2d(spark, d):
    m = LinearRegression().fit(read_table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return one_row(spark, c0=round(float(m.coef_[0]), 3), c1=round(float(m.coef_[1]), 3))


@query(f"with m as {MOMENTS} select {LINE_SQL}, round(mp + u/a*(l_quantity-mq), 3) prediction from lineitem cross join m")
def linear_predict(spark, d):
    df = read_table(spark, d, "lineitem")
    m = LinearRegression().fit(df, ["l_quantity"], "l_extendedprice")
    return m.predict(df, keep=LINE).withColumn("prediction", F.round("prediction", 3))


@query(f"with m as {MOMENTS} select round(n*u/(n*a+5e5), 4) coef, round(mp - n*u/(n*a+5e5)*mq, 4) intercept from m")
def ridge_1d(spark, d):
    m = Ridge(alpha=5e5).fit(read_table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    row = one_row(spark, coef=float(m.coef_[0]), intercept=float(m.intercept_))
    return row.select(*[F.round(x, 4).alias(x) for x in row.columns])


@query(f"with m as {MOMENTS} select round(sign(u)*greatest(abs(u)-1000, 0)/a, 4) coef from m")
def lasso_1d(spark, d):
    m = Lasso(alpha=1000.0).fit(read_table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return one_row(spark, coef=round(float(m.coef_[0]), 4))


@query(f"with m as {MOMENTS} select round(sign(u)*greatest(abs(u)-500, 0)/(a+500), 4) coef from m")
def elastic_net_1d(spark, d):
    m = ElasticNet(alpha=1000.0, l1_ratio=0.5).fit(read_table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return one_row(spark, coef=round(float(m.coef_[0]), 4))


# With one yes-or-no feature and no penalty, the fitted probabilities are the shares of the classes on either side.


def _long_or_short(spark, d) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "lang", (F.length("text") > 1000).cast("double").alias("long"))
    return docs.join(read_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


LONG = "s as (select d.doc_id, d.lang, l.quality, length(d.text) > 1000 long from documents d left join labels l using (doc_id))"


@query(f"with {LONG} select doc_id, round(avg(quality) over (partition by long), 3) probability_1 from s where quality is not null")
def logistic_predict(spark, d):
    df = _long_or_short(spark, d).filter("quality is not null")
    model = make_pipeline(StandardScaler(), LogisticRegression(penalty=None, tol=1e-10, max_iter=300)).fit(df, features=["long"], label="quality")
    return model.predict_proba(df, keep=["doc_id"]).select("doc_id", F.round("probability_1", 3).alias("probability_1"))


LANGS = ["de", "en", "es", "fr"]


@query(f"with {LONG} select doc_id, " + ", ".join(f"round(avg((lang = '{v}')::int) over (partition by long), 3) probability_{v}" for v in LANGS) + " from s")
def logistic_multiclass(spark, d):
    df = _long_or_short(spark, d).select("doc_id", "lang", "long")
    model = LogisticRegression(penalty=None, tol=1e-8, max_iter=500).fit(df, features=["long"], label="lang")
    named = model.predict_proba(df, keep=["doc_id"]).toDF("doc_id", *[f"probability_{v}" for v in LANGS])
    return named.select("doc_id", *[F.round(f"probability_{v}", 3).alias(f"probability_{v}") for v in LANGS])


#: Stratified folds of the labelled documents, as in stratified_kfold.
FOLDS3 = (
    "y as (select doc_id, long, quality from s where quality is not null), k as (select *, row_number() over (partition by quality order by doc_id) - 1 j from y),"
    " st as (select quality, sum(c) over (order by quality) - c a, c from (select quality, count(*) c from y group by quality)),"
    " q as (select quality, f, (select count(*) from range(a::bigint, (a + c)::bigint) t(x) where x % 3 = f) q from st cross join range(3) g(f)),"
    " e as (select quality, f, sum(q) over (partition by quality order by f) e from q),"
    " z as (select long, quality, (select count(*) from e where e.quality = k.quality and e.e <= k.j) fold from k)"
)


@query(
    f"with {LONG}, {FOLDS3}, m as (select g.f, z.long, (avg(quality) >= 0.5)::int p from z join range(3) g(f) on z.fold <> g.f group by all)"
    " select fold::int fold, round(avg((p = quality)::int), 6) score from z join m on m.f = z.fold and m.long = z.long group by fold"
)
def cross_validation(spark, d):
    df = _long_or_short(spark, d).filter("quality is not null")
    model = make_pipeline(StandardScaler(), LogisticRegression(penalty=None, tol=1e-10, max_iter=300))
    scores = cross_val_score(model, df, ["long"], "quality", order_by="doc_id", cv=3)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(scores)], "fold int, score double")


#: Regression of the retail price on the size, trained on two folds of three and judged on the third.
FOLD_LINES = (
    "n as (select p_size x, p_retailprice y, row_number() over (order by p_partkey) - 1 i, count(*) over () n from part),"
    " z as (select x, y, (case when i < (n%3)*(n//3+1) then i//(n//3+1) else n%3 + (i-(n%3)*(n//3+1))//(n//3) end)::int fold from n),"
    " m as (select f::int f, regr_slope(y, x) a, regr_intercept(y, x) b from z join range(3) g(f) on z.fold <> g.f group by f)"
)


@query(
    f"with {FOLD_LINES} select fold, round(-avg((y-a*x-b)*(y-a*x-b)), 4) squared, round(-avg(abs(y-a*x-b)), 4) absolute,"
    " round(1 - sum((y-a*x-b)*(y-a*x-b))/(count(y)*var_pop(y)), 6) r2 from z join m on f = fold group by fold"
)
def scorers(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    by = [cross_val_score(LinearRegression(), df, ["p_size"], "p_retailprice", order_by="p_partkey", cv=3, scoring=s) for s in ("neg_mean_squared_error", "neg_mean_absolute_error", None)]
    rows = [(i, round(float(a), 4), round(float(b), 4), round(float(r), 6)) for i, (a, b, r) in enumerate(zip(*by, strict=True))]
    return spark.createDataFrame(rows, "fold int, squared double, absolute double, r2 double")


# Neighbours: the stated query set, vectors with vec_id % 20 = 0, asks all vectors, itself included.


def _knn_sql(metric: str) -> str:
    dist = {"l2": "list_distance(q.e, t.e)", "l1": "list_sum(list_transform(list_zip(q.e, t.e), lambda z: abs(z[1] - z[2])))"}[metric]
    return f"(select *, row_number() over (partition by query order by distance, neighbor) rk from (select q.vec_id query, t.vec_id neighbor, t.label, {dist} distance from v q join v t on q.vec_id % 20 = 0))"


V = "v as (select vec_id, label, embedding::DOUBLE[] e from embeddings)"


def _sides(spark, d):
    df = read_table(spark, d, "embeddings")
    return df, df.filter("vec_id % 20 = 0")


@query(f"with {V} select query, rk::int rank, neighbor, round(distance, 6) distance from {_knn_sql('l2')} where rk <= 5")
def knn_kneighbors(spark, d):
    train, ask = _sides(spark, d)
    return rounded(KNeighborsClassifier().fit(train, ["embedding"], "label", "vec_id").kneighbors(ask), ["distance"])


@query(f"with {V} select query, rk::int rank, neighbor, round(distance, 6) distance from {_knn_sql('l1')} where rk <= 3")
def knn_manhattan(spark, d):
    train, ask = _sides(spark, d)
    return rounded(KNeighborsClassifier(3, p=1).fit(train, ["embedding"], "label", "vec_id").kneighbors(ask), ["distance"])


@query(f"with {V}, b as (select query, label, count(*) n from {_knn_sql('l2')} where rk <= 5 group by all) select query vec_id, arg_min(label, row(-n, label))::int prediction from b group by query")
def knn_classify(spark, d):
    train, ask = _sides(spark, d)
    return KNeighborsClassifier().fit(train, ["embedding"], "label", "vec_id").predict(ask, keep=["vec_id"])


@query(f"with {V}, b as (select query, label, sum(case when exact then (distance = 0)::int else 1/distance end) n from (select *, min(distance) over (partition by query) = 0 exact from {_knn_sql('l2')} where rk <= 5) group by all) select query vec_id, arg_min(label, row(-n, label))::int prediction from b group by query")
def knn_classify_distance(spark, d):
    train, ask = _sides(spark, d)
    return KNeighborsClassifier(weights="distance").fit(train, ["embedding"], "label", "vec_id").predict(ask, keep=["vec_id"])


@query(f"with {V}, b as (select * from {_knn_sql('l2')} where rk <= 5) select query vec_id, " + ", ".join(f"avg((label = {i})::int) probability_{i}" for i in range(10)) + " from b group by query")
def knn_predict_proba(spark, d):
    train, ask = _sides(spark, d)
    return KNeighborsClassifier().fit(train, ["embedding"], "label", "vec_id").predict_proba(ask, keep=["vec_id"])


@query(f"with {V} select query vec_id, round(avg(label), 6) prediction from {_knn_sql('l2')} where rk <= 7 group by query")
def knn_regress(spark, d):
    train, ask = _sides(spark, d)
    return rounded(KNeighborsRegressor(7).fit(train, ["embedding"], "label", "vec_id").predict(ask, keep=["vec_id"]), ["prediction"])


# Composition


@query(f"with g as {GAPS}, s as (select avg(v) m from g), f as (select event_id, coalesce(v, m) x from g cross join s), z as (select avg(x) a, stddev_pop(x) b from f) select event_id, round((x-a)/b, 6) v from f cross join z")
def pipeline_impute_scale(spark, d):
    df = _gaps(spark, d).select("event_id", "v")
    return rounded(make_pipeline(SimpleImputer(), StandardScaler()).fit(df, features=["v"]).transform(df), ["v"])


@query(
    "with s as (select avg(o_totalprice) m, stddev_pop(o_totalprice) sd from orders) select o_orderkey, round((o_totalprice-m)/sd, 6) num__o_totalprice, "
    + ", ".join(f"""(o_orderstatus = '{v}')::int::double "cat__o_orderstatus_{v}\"""" for v in STATUS)
    + " from orders cross join s"
)
def column_transformer_mixed(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    t = ColumnTransformer([("num", StandardScaler(), ["o_totalprice"]), ("cat", OneHotEncoder(), ["o_orderstatus"])], keep=["o_orderkey"])
    return rounded(t.fit(df).transform(df), ["num__o_totalprice"])


@query(
    "with s as (select min(p_size) a, max(p_size) b, max(abs(p_retailprice)) m, avg(p_size) u, stddev_pop(p_size) w from part)"
    ' select p_partkey, round((p_size-a)/(b-a), 6) "size_of_minmaxscaler", round(p_retailprice/m, 6) "price_of_maxabsscaler", round(p_size/w - u/w, 6) "size_of_standardscaler", p_brand "brand_of_remainder" from part cross join s'
)
def column_transformer_selectors(spark, d):
    """Branches chosen by place, by a mask, by a callable; one column in two branches; own output names; the rest passes."""
    df = read_table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    t = make_column_transformer(
        (MinMaxScaler(), 0), (MaxAbsScaler(), [False, True, False]), (StandardScaler(), lambda x: [n for n in x.columns if n.endswith("ize")]),
        remainder="passthrough", keep=["p_partkey"], verbose_feature_names_out=lambda branch, name: f"{name}_of_{branch}",
    )
    out = t.fit(df).transform(df)
    return rounded(out, out.columns[1:4])


@query("select unnest(range(5)) place, unnest(['num__l_quantity', 'num__l_extendedprice', 'cat__l_returnflag_A', 'cat__l_returnflag_N', 'cat__l_returnflag_R']) as name")
def feature_names(spark, d):
    df = read_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    t = ColumnTransformer([("num", make_pipeline(SimpleImputer(), StandardScaler()), slice("l_quantity", "l_extendedprice")), ("cat", OneHotEncoder(), [-1])])
    names = t.fit(df).get_feature_names_out()
    return spark.createDataFrame(list(enumerate(names)), "place long, name string")


@query(
    "with s as (select max(abs(o_totalprice)) m from orders) select o_orderkey as row, 0::bigint col, round(o_totalprice/m, 6) as value from orders cross join s"
    " union all select o_orderkey, 1 + (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end), 1.0 from orders"
)
def column_transformer_coo(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    t = ColumnTransformer([("num", MaxAbsScaler(), ["o_totalprice"]), ("cat", OneHotEncoder(), ["o_orderstatus"])], keep=["o_orderkey"])
    return rounded(t.fit(df).to_coo(df, "o_orderkey"), ["value"])
