"""
columns, one row, NaN, dotted names, ties."""

import math

import pytest
from pyspark.sql import functions as F

from gridscope.operators import aggregates as A
from gridscope.operators import charts as K
from gridscope.operators import clean as B
from gridscope.operators import order as O
from gridscope.operators import outliers as OUT
from gridscope.operators import profile as P
from gridscope.operators import relations as R
from gridscope.operators import semantic as C


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1.0, 5.0, None, "x", float("nan")), (2.0, 5.0, None, "y", 1.0), (2.0, 5.0, None, "y", 2.0)]
    return spark.createDataFrame(rows, "`a.b` double, const double, allnull string, cat string, withnan double")


def test_describe_dotted_constant_nan(odd):
    d = {r["column"]: r for r in A.describe(odd, ["a.b", "const", "withnan"]).collect()}
    assert d["a.b"]["count"] == 3 and d["a.b"]["p50"] == 2.0
    assert d["const"]["std"] == 0.0
    assert d["withnan"]["count"] == 2  # NaN is treated as missing
    m = {r["column"]: r for r in A.moments(odd, ["const"]).collect()}
    assert m["const"]["skewness"] is None or math.isnan(m["const"]["skewness"])


def test_empty_frame(spark):
    e = spark.createDataFrame([], "x double, c string")
    assert A.describe(e, ["x"]).count() == 0
    assert [r["q"] for r in O.quantiles(e, "x", [0.5]).collect()] in ([], [None])
    assert B.drop_empty_columns(e).columns == []  # vacuously all-NULL, as pandas drops them
    q = C.quality_scores(e, ["x", "c"]).collect()
    assert all(r["quality_score"] == 0.0 for r in q)


def test_one_row_quantiles(spark):
    one = spark.createDataFrame([(7.0,)], "x double")
    assert [r["q"] for r in O.quantiles(one, "x", [0.0, 0.5, 1.0]).orderBy("p").collect()] == [7.0, 7.0, 7.0]


def test_all_null_and_types(odd):
    st = {r["column"]: r["type"] for r in C.structural_types(odd).collect()}
    assert st["allnull"] == "empty" and st["a.b"] == "numeric"
    sem = {r["column"]: r for r in C.semantic_types(odd).collect()}
    assert sem["allnull"]["type"] == "unknown"
    assert B.empty_columns(odd) == ["allnull"]


def test_constant_column_relations_and_charts(odd):
    pairs = R.pearson_pairs(odd, ["a.b", "const"]).first()
    assert pairs["corr"] is None or math.isnan(pairs["corr"])
    h = K.histogram(odd, "const").collect()
    assert len(h) == 1 and h[0]["count"] == 3
    assert OUT.iqr_outliers(odd, ["a.b"]).count() == 0  # fewer than 10 rows: skipped


def test_ties_in_frequency(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    f = A.frequency_summary(df, ["v"]).first()
    assert (f["most_frequent"], f["most_frequent_count"]) == ("a", 2)
    assert (f["least_frequent"], f["least_frequent_count"]) == ("c", 1)
    m = A.mode(spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,)], "x double"), ["x"]).first()
    assert m["mode"] == 1.0


def test_duplicate_and_empty_headers():
    assert B.standard_names(["a", "a", "a_1", ""]) == ["a", "a_1", "a_1_1", "Column_4"]


def test_profiles_on_odd(odd):
    prof = {r["column"]: r for r in P.column_profile(odd).collect()}
    assert prof["allnull"]["null_count"] == 3 and prof["allnull"]["samples"] == []
    assert prof["cat"]["samples"] == ["x", "y"]
    q = P.data_quality(odd).first()
    assert q["duplicate_rows"] == 0 and "allnull" in q["columns_with_nulls"]


def test_zero_divisors_do_not_raise(spark, odd):
    from gridscope.operators import timeseries as G
    e = spark.createDataFrame([], "x double, s string")
    assert C.numeric_candidates(e, ["x"]).count() == 0
    assert C.date_like_columns(odd).count() >= 1
    assert P.data_quality(e).count() == 1
    const = spark.createDataFrame([(5.0,)] * 20, "x double")
    assert OUT.zscore_outliers(const, ["x"]).first()["outlier_count"] == 0
    assert OUT.modified_z_outliers(const, ["x"]).first()["outlier_count"] == 0
    assert K.radar(spark.createDataFrame([(1.0, 1.0, 1.0)], "a double, b double, c double"), ["a", "b", "c"]).count() == 3
