"""Special functions against printed table values; property checks of the
statistics operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.functions import special
from gridscope.operators import charts as K
from gridscope.operators import models as H
from gridscope.operators import outliers as O
from gridscope.operators import relations as R
from gridscope.operators import stattests as T
from gridscope.operators.aggregates import to_long
from paths import SF_MID


def test_t_table_values():
    # two-sided 5 % critical values from a t table
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert special.t_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=2e-4)
    assert special.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=2e-4)


def test_chi2_and_normal():
    assert special.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=2e-4)
    assert special.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=2e-4)
    assert special.norm_sf(1.6449) == pytest.approx(0.05, abs=1e-4)
    assert special.norm_ppf(0.975) == pytest.approx(1.95996, abs=1e-4)


@pytest.fixture(scope="module")
def part(spark):
    return spark.read.parquet(f"{SF_MID}/part.parquet")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_MID}/events.parquet")


def test_normality_p_values_in_range(spark, part, events):
    sw = T.shapiro_wilk(part, "p_retailprice").first()
    assert 0 < sw["statistic"] <= 1 and 0 <= sw["p_value"] <= 1
    ad = T.anderson_darling(events, "value").first()
    assert ad["statistic"] > ad["critical_value"]  # right-skewed values are not normal
    ks = T.ks_normal(events, "value").first()
    assert 0 <= ks["p_value"] <= 1 and ks["statistic"] > 0
    dp = T.dagostino_pearson(events, ["value"]).first()
    assert dp["p_value"] < 0.05


def test_shapiro_on_normal_sample(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=400)], "x double")
    r = T.shapiro_wilk(df, "x").first()
    assert r["statistic"] > 0.98 and r["p_value"] > 0.01


def test_normal_scores_and_their_sums():
    from statistics import NormalDist
    nd = NormalDist()
    p = np.concatenate([10.0 ** -np.arange(1, 13), np.linspace(0.001, 0.999, 400)])
    assert np.allclose(T.normal_scores(p), [nd.inv_cdf(x) for x in p], rtol=1e-11, atol=1e-13)
    n = 300_000
    m = T.normal_scores((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    starts, counts = np.array([0, 0, 5, 20_000, 290_000, 100, 0]), np.array([n, 2, 1, 200_000, 10_000, 12_000, 1])
    sums, squares = T.score_sums(starts, counts, n)
    for s, k, a, b in zip(starts, counts, sums, squares, strict=True):
        part = m[max(s, 2):min(s + k, n - 2)]
        assert abs(a - part.sum()) < 1e-7 and b == pytest.approx((part ** 2).sum(), rel=1e-11, abs=1e-12)


def test_shapiro_of_a_few_frequent_values(spark):
    """A value with most of the rows costs one row, not one step a position."""
    df = spark.range(400_000).select(F.when(F.col("id") < 300_000, 1.0).when(F.col("id") < 390_000, 2.0).otherwise(F.col("id") % 7).alias("x"))
    r = T.shapiro_wilk(df, "x").first()
    x = np.sort(np.array([v["x"] for v in df.collect()]))
    n = len(x)
    m = T.normal_scores((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    an, an1, d = T._swilk_ends(n, m[-1], m[-2], float(m @ m))
    a = m / d
    a[[0, 1, -2, -1]] = -an, -an1, an1, an
    assert r["statistic"] == pytest.approx(float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()), abs=1e-9)


def test_two_sample_tests(spark, events):
    t = T.t_test(events, "value", "event_type").first()
    assert 0 <= t["p_value"] <= 1
    m = T.mann_whitney(events, "value", "event_type").first()
    assert 0 <= m["p_value"] <= 1 and m["u_statistic"] > 0


def test_partial_correlation_closed_form(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pc = {(r["var1"], r["var2"]): r["correlation"] for r in R.partial_correlations(li, cols).collect()}
    c = li.agg(F.corr(cols[0], cols[1]).alias("ab"), F.corr(cols[0], cols[2]).alias("ac"),
               F.corr(cols[1], cols[2]).alias("bc")).first()
    exp = (c["ab"] - c["ac"] * c["bc"]) / math.sqrt((1 - c["ac"] ** 2) * (1 - c["bc"] ** 2))
    assert pc[(cols[0], cols[1])] == pytest.approx(exp, abs=1e-9)


def test_kmeans_elbow_and_pca(spark, part):
    vec = H.standardized_vectors(part, ["p_size", "p_retailprice"]).cache()
    _, curve = H.elbow_k(vec, vec.count())
    inertias = [i for _, i in curve]
    assert all(b <= a * 1.05 for a, b in zip(inertias, inertias[1:]))
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    p = H.pca(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).collect()
    assert sum(r["explained_variance_ratio"] for r in p) == pytest.approx(1.0)
    assert p[-1]["cumulative_variance"] == pytest.approx(1.0)


def test_isolation_forest_share(spark, events):
    r = O.isolation_forest(events, ["value"]).first()
    assert 8.0 <= r["outlier_percentage"] <= 12.0


def test_functional_dependencies_brute_force(spark):
    """Keys, classes of several rows, nulls on both sides and an all-null column."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i // 2), "g%d" % (i // 4), None if i % 8 < 4 else "h", int(rng.integers(0, 3)), None if i == 7 else i * 3, None)
            for i in range(48)]
    cols = ["k", "pair", "four", "half", "any", "gap", "void"]
    df = spark.createDataFrame(rows, "k int, pair int, four string, half string, any int, gap int, void string")
    got = {(r["determinant"], r["dependent"]): (r["groups"], r["is_key"]) for r in R.functional_dependencies(df).collect()}
    want = {}
    for i, a in enumerate(cols):
        classes = {}
        for r in rows:
            if r[i] is not None:
                classes.setdefault(r[i], []).append(r)
        for j, b in enumerate(cols):
            if i != j and all(len({r[j] for r in g} - {None}) == 1 for g in classes.values()):
                want[a, b] = (len(classes), len(classes) == sum(len(g) for g in classes.values()))
    assert got == want and ("pair", "four") in want and ("k", "gap") not in want and ("gap", "k") in want
    assert R.functional_dependencies(df.select("k")).count() == 0
    assert {r["groups"] for r in R.functional_dependencies(df.limit(0)).collect()} == {0}


def test_isolation_steps_equal_the_walk_and_duckdb(spark, events):
    """The step table scores like the trees, and DuckDB finds the same outliers from
    the stored steps."""
    import duckdb
    df = events.selectExpr("value", "CAST(floor(value / 7) AS DOUBLE) AS coarse", "CAST(NULL AS DOUBLE) AS void")
    cols = ["value", "coarse", "void"]
    counts = to_long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("cnt").alias("n")).collect()}
    assert set(sizes) == {"value", "coarse"}
    forest = O.isolation_trees(counts, sizes)
    steps = O.isolation_steps(forest)
    got = O.isolation_scores(counts, steps).toPandas()
    trees = forest.toPandas()
    for col, g in got.groupby("column"):
        walked = O.tree_scores(trees[trees["column"] == col], g["value"].to_numpy())
        assert np.array_equal(walked, g["score"].to_numpy())
    con = duckdb.connect()
    con.register("steps", steps.toPandas())
    con.register("counted", got[["column", "value", "cnt"]])
    want = {r[0]: r[1:] for r in con.sql("""
        WITH s AS (SELECT "column" AS col, coalesce(lower_bound, '-infinity'::DOUBLE) AS lo, score FROM steps
                   WHERE lower_bound IS NULL OR NOT isnan(lower_bound) OR step = 0),
        st AS (SELECT col, CASE WHEN isnan(lo) THEN '-infinity'::DOUBLE ELSE lo END AS lo, score FROM s),
        v AS (SELECT c."column" AS col, c.value, unnest(range(c.cnt)) AS k FROM counted c),
        x AS (SELECT v.col, v.value, st.score FROM v ASOF JOIN st ON v.col = st.col AND v.value >= st.lo),
        q AS (SELECT col, quantile_cont(score, 0.9) AS cut, count(*) AS n FROM x GROUP BY col)
        SELECT x.col, count(*) FILTER (WHERE x.score > q.cut), any_value(q.n) FROM x JOIN q USING (col) GROUP BY x.col""").fetchall()}
    for r in O.isolation_forest(df, cols).collect():
        count, n = want[r["column"]]
        assert r["outlier_count"] == count and r["outlier_percentage"] == pytest.approx(count / n * 100)
        assert len(r["outlier_values"] or []) == min(5, count)


def test_isolation_forest_edges(spark):
    assert O.isolation_forest(spark.createDataFrame([], "x double"), ["x"]).count() == 0
    same = spark.createDataFrame([(1.0,)] * 12, "x double")
    r = O.isolation_forest(same, ["x"]).first()
    assert (r["outlier_count"], r["outlier_percentage"], r["outlier_values"]) == (0, 0.0, None)


def test_density_integrates_to_one(spark, events):
    d = sorted((r["x"], r["density"]) for r in K.density(events, "value").collect())
    xs, ys = np.array([x for x, _ in d]), np.array([y for _, y in d])
    area = float(np.sum((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2))
    assert 0.9 < area < 1.05


def test_kendall_small_brute_force(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 3.0), (3.0, 5.0), (5.0, 5.0), (6.0, 4.0), (2.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = R.kendall_tau_b(df, "x", "y").first()["tau_b"]
    n = len(rows)
    s = sum(np.sign(rows[i][0] - rows[j][0]) * np.sign(rows[i][1] - rows[j][1]) for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in np.unique([r[0] for r in rows], return_counts=True)[1])
    ty = sum(c * (c - 1) / 2 for c in np.unique([r[1] for r in rows], return_counts=True)[1])
    assert got == pytest.approx(s / math.sqrt((n0 - tx) * (n0 - ty)))


def test_adf_matches_direct_regression(spark):
    import datetime
    from gridscope.operators import timeseries as G
    rng = np.random.default_rng(0)
    n = 300
    rw = np.cumsum(rng.normal(size=n))
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), i, float(rw[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp, id long, v double")
    r = G.adf_test(df, "ts", "id", "v").first()

    # the same procedure written directly with numpy on the whole series
    K = min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25)))
    d = np.diff(rw)

    def design(lag, start):
        X = [[1.0, rw[t]] + [d[t - j] for j in range(1, lag + 1)] for t in range(start, len(d))]
        return np.array(X), d[start:]

    best, best_aic = 0, np.inf
    for lag in range(K + 1):
        X, y = design(lag, K)
        b = np.linalg.lstsq(X, y, rcond=None)[0]
        ssr = ((y - X @ b) ** 2).sum()
        aic = len(y) * (np.log(2 * np.pi) + np.log(ssr / len(y)) + 1) + 2 * X.shape[1]
        if aic < best_aic - 1e-12:
            best, best_aic = lag, aic
    X, y = design(best, best)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    res = y - X @ b
    se = np.sqrt(res @ res / (len(y) - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1])
    assert r["used_lag"] == best and r["nobs"] == len(y)
    assert r["adf_statistic"] == pytest.approx(b[1] / se, rel=1e-9)
    assert 0 <= r["p_value"] <= 1 and r["crit_1"] < r["crit_5"] < r["crit_10"]


@pytest.mark.parametrize("buckets", [None, 25])
def test_lag_grams_match_the_design_matrix(spark, monkeypatch, buckets):
    """Cross products of every lag order, also where halos reach over several buckets."""
    from gridscope.operators import order, timeseries as G
    monkeypatch.setattr(order, "BUCKETS", buckets)
    rng = np.random.default_rng(4)
    n, width = 120, 9
    x = np.cumsum(rng.normal(size=n)) + 40
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, x double").repartition(5)
    got = G.lag_grams(df, ["t"], n, width)
    x = x - x.mean()
    d = np.diff(x)
    for p in (0, 1, 4, width):
        z = np.array([[1.0, x[t - 1], *[d[t - 1 - j] for j in range(1, p + 1)], d[t - 1]] for t in range(p + 1, n)])
        assert np.allclose(got.gram(p), z.T @ z, rtol=1e-9, atol=1e-9)


def test_adf_of_short_and_constant_series(spark):
    from gridscope.operators import timeseries as G
    rows = lambda xs: spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(xs)], "ts long, id long, v double")
    assert G.adf_test(rows([1, 2, 3]), "ts", "id", "v").count() == 0
    r = G.adf_test(rows([5] * 40), "ts", "id", "v").first()
    assert r["adf_statistic"] is None and r["nobs"] == 40


def test_similar_columns_groups_twins(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 300))
    rows = [(float(x), float(2 * x + 1), float(y), float(-3 * y), float(z), float(z + 0.001 * x))
            for x, y, z in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, a2 double, b double, b2 double, c double, c2 double")
    groups = [set(r["columns"]) for r in R.similar_columns(df, ["a", "a2", "b", "b2", "c", "c2"]).collect()]
    assert {"a", "a2"} in groups or any({"a", "a2"} <= g for g in groups)
    assert all(len(g) > 1 for g in groups)
