"""Model and hypothesis-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import models as H
from gridscope.operators import stattests as T
from gridscope.plans.catalog import query, round_cols, t


@query("kmeans_summary")
def kmeans_summary(spark, sf):
    """H1-H3: elbow-chosen k-means over part's numbers; per-cluster summary
    (rows-only check: labels depend on initialisation)."""
    _, _, summary, _, _, _ = H.kmeans(t(spark, sf, "part"), ["p_size", "p_retailprice"])
    return round_cols(summary)


@query("pca_variance")
def pca_variance(spark, sf):
    """H4 over lineitem's measures (rows-only)."""
    return round_cols(H.pca(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


PART = ["p_size", "p_retailprice"]


@query("kmeans_nearest", """
SELECT p_size, p_retailprice, count(*) AS n, TRUE AS nearest FROM part
WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY ALL""")
def kmeans_nearest(spark, sf):
    """H1, H2: every row's label is its nearest centre, on scores computed anew."""
    part = t(spark, sf, "part").dropna(subset=PART)
    labelled, centres, _, _, _, _ = H.kmeans(part, PART)
    st = part.agg(*[f(x).alias(f"{n}_{x}") for x in PART for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = labelled.crossJoin(F.broadcast(st)).crossJoin(F.broadcast(centres.withColumnRenamed("cluster", "other")))
    d = sum((F.pow((F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}") - F.col("center")[i], F.lit(2)) for i, x in enumerate(PART)), F.lit(0.0))
    each = both.groupBy(*PART, "cluster").agg(F.min(d).alias("least"), F.min(F.when(F.col("cluster") == F.col("other"), d)).alias("own"),
                                              F.count_if(F.col("cluster") == F.col("other")).alias("n"))
    typed = [F.col(x).cast(part.schema[x].dataType).alias(x) for x in PART]  # k-means has them as doubles
    return each.groupBy(*typed).agg(F.sum("n").alias("n"), F.bool_and(F.col("own") <= F.col("least") + 1e-9).alias("nearest"))


@query("cluster_totals", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS column, count(*) AS n, round(avg({x}), 6) AS mean, round(avg({x}::DOUBLE * {x}), 3) AS mean_square, "
    f"min({x})::DOUBLE AS lowest, max({x})::DOUBLE AS highest, 100.0::DOUBLE AS percentage FROM part" for x in PART))
def cluster_totals(spark, sf):
    """The clusters' sizes, means, deviations and ends put together give
    those of all rows."""
    _, _, summary, _, _, _ = H.kmeans(t(spark, sf, "part"), PART)
    n = F.sum("size")
    squares = (F.col("size") - 1) * F.coalesce(F.col("std"), F.lit(0.0)) ** 2 + F.col("size") * F.col("mean") ** 2
    return summary.groupBy("column").agg(
        n.alias("n"), F.round(F.sum(F.col("size") * F.col("mean")) / n, 6).alias("mean"), F.round(F.sum(squares) / n, 3).alias("mean_square"),
        F.min("min").alias("lowest"), F.max("max").alias("highest"), F.round(F.sum("percentage"), 6).alias("percentage"))


PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pca_invariants", "WITH m AS (" + "\nUNION ALL\n".join(
    f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(PCA_COLS) for j, b in enumerate(PCA_COLS)) + """),
p2 AS (SELECT x.i, y.j, sum(x.r * y.r) AS r FROM m x JOIN m y ON x.j = y.i GROUP BY ALL),
p3 AS (SELECT x.i, y.j, sum(x.r * y.r) AS r FROM p2 x JOIN m y ON x.j = y.i GROUP BY ALL),
p4 AS (SELECT x.i, y.j, sum(x.r * y.r) AS r FROM p3 x JOIN m y ON x.j = y.i GROUP BY ALL)
SELECT 1 AS power, round(sum(r), 8) AS trace, TRUE AS eigenvectors FROM m WHERE i = j
UNION ALL SELECT 2, round(sum(r), 8), TRUE FROM p2 WHERE i = j
UNION ALL SELECT 3, round(sum(r), 8), TRUE FROM p3 WHERE i = j
UNION ALL SELECT 4, round(sum(r), 8), TRUE FROM p4 WHERE i = j""")
def pca_invariants(spark, sf):
    """H4: the power sums of the four eigenvalues, which fix them all, are the traces
    of the powers of the correlation matrix; the component vectors are eigenvectors
    of the pairwise correlations."""
    li = t(spark, sf, "lineitem")
    k = len(PCA_COLS)
    parts = H.pca(li, PCA_COLS, n_vectors=k)
    eigen = F.col("explained_variance_ratio") * k
    r = li.agg(F.array(*[F.array(*[F.corr(a, b) for b in PCA_COLS]) for a in PCA_COLS]).alias("r"))
    image = F.transform("r", lambda row: F.aggregate(F.zip_with(row, "loadings", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    off = F.aggregate(F.zip_with(image, F.col("loadings"), lambda a, v: F.abs(a - eigen * v)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    both = parts.crossJoin(F.broadcast(r)).select(eigen.alias("e"), (off < 1e-8).alias("ok"))
    return both.select("ok", F.posexplode(F.array(*[F.pow("e", F.lit(p)) for p in range(1, k + 1)])).alias("p", "v")).groupBy(
        (F.col("p") + 1).alias("power")).agg(F.round(F.sum("v"), 8).alias("trace"), F.bool_and("ok").alias("eigenvectors"))


@query("simple_regression", """
SELECT 'l_extendedprice' AS target, round(regr_slope(l_extendedprice, l_quantity), 6) AS coefficient,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared,
  round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 1)), 4) AS residual_std,
  count(*) AS n FROM lineitem
UNION ALL
SELECT 'l_quantity', round(regr_slope(l_quantity, l_extendedprice), 9), round(regr_intercept(l_quantity, l_extendedprice), 4),
  round(regr_r2(l_quantity, l_extendedprice), 6),
  round(sqrt(regr_syy(l_quantity, l_extendedprice) * (1 - regr_r2(l_quantity, l_extendedprice)) / (count(*) - 1)), 4),
  count(*) FROM lineitem""")
def simple_regression(spark, sf):
    """H5 with two columns: each regressed on the other."""
    r = H.regress_each(t(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return r.select("target", F.when(F.col("target") == "l_quantity", F.round(F.col("coefficients")[0], 9))
                    .otherwise(F.round(F.col("coefficients")[0], 6)).alias("coefficient"),
                    F.round("intercept", 4).alias("intercept"), F.round("r_squared", 6).alias("r_squared"),
                    F.round("residual_std", 4).alias("residual_std"), "n")


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _det(m):
    """Determinant of a matrix of SQL expressions, along the first row."""
    if len(m) == 1:
        return m[0][0]
    terms = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({_det([r[:j] + r[j + 1:] for r in m[1:]])})" for j in range(len(m))]
    return " ".join(terms)


def _regression_sql(y):
    """Cramer's rule on the covariances."""
    xs = [x for x in MEASURES if x != y]
    cov = lambda p, q: f"c_{min(p, q)}_{max(p, q)}"
    s = [[cov(p, q) for q in xs] for p in xs]
    beta = [f"(({_det([[cov(p, y) if k == j else s[i][k] for k in range(3)] for i, p in enumerate(xs)])}) / ({_det(s)}))" for j in range(3)]
    explained = " + ".join(f"{b} * {cov(x, y)}" for b, x in zip(beta, xs))
    intercept = f"m_{y} - (" + " + ".join(f"{b} * m_{x}" for b, x in zip(beta, xs)) + ")"
    return (f"SELECT '{y}' AS target, round({intercept}, 4) AS intercept, round(({explained}) / {cov(y, y)}, 6) AS r_squared, "
            f"round(sqrt(({cov(y, y)} - ({explained})) * n / (n - 1)), 4) AS residual_std, n FROM s")


@query("regress_each", "WITH s AS (SELECT count(*) AS n, " + ", ".join(
    [f"avg({x}) AS m_{x}" for x in MEASURES] + [f"covar_pop({p}, {q}) AS c_{min(p, q)}_{max(p, q)}"
                                                for i, p in enumerate(MEASURES) for q in MEASURES[i:]])
       + " FROM lineitem)\n" + "\nUNION ALL\n".join(_regression_sql(y) for y in MEASURES))
def regress_each(spark, sf):
    """H5 over four measures."""
    r = H.regress_each(t(spark, sf, "lineitem"), MEASURES)
    return round_cols(r.select("target", "intercept", "r_squared", "residual_std", "n"), {"intercept": 4, "residual_std": 4})


@query("durbin_watson", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
             l_extendedprice - (a + b * l_quantity) AS e FROM lineitem, f),
l AS (SELECT e, lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p FROM r)
SELECT round(sum((e - p) * (e - p)) / sum(e * e), 6) AS durbin_watson FROM l""")
def durbin_watson(spark, sf):
    """H6 on the residuals of price ~ quantity in (orderkey, linenumber,
    partkey, suppkey, quantity, price) order (the first two alone are not
    unique; rows equal on all six have equal residuals)."""
    li = t(spark, sf, "lineitem")
    fit = H.regress_each(li, ["l_extendedprice", "l_quantity"]).filter("target = 'l_extendedprice'").first()
    res = H.residuals(li, "l_extendedprice", ["l_quantity"], fit["coefficients"], fit["intercept"],
                      keep=DW_ORDER, means=fit["means"])
    return round_cols(H.durbin_watson(res, "resid", DW_ORDER))


DW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _dagostino_sql(tbl, col):
    return f"""
SELECT '{col}' AS column, CAST(n AS BIGINT) AS n, round(z1, 6) AS z_skew, round(z2, 6) AS z_kurt,
  round(z1 * z1 + z2 * z2, 6) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value,
  exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal
FROM (
 SELECT n, delta * ln(yy / alpha + sqrt((yy / alpha) ^ 2 + 1)) AS z1,
   ((1 - 2 / (9.0 * a)) - cbrt((1 - 2.0 / a) / (1 + x * sqrt(2 / (a - 4.0))))) / sqrt(2 / (9.0 * a)) AS z2
 FROM (
  SELECT n, CASE WHEN y = 0 THEN 1.0 ELSE y END AS yy, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
    (b2 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))) AS x,
    6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a
  FROM (
   SELECT n, b2, g1 * sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2))) AS y,
     -1 + sqrt(2 * ((3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
     6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3))) AS sb1
   FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS g1,
                avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) AS b2
         FROM (SELECT {col} AS x, avg({col}) OVER () AS mu FROM {tbl} WHERE {col} IS NOT NULL)))))
WHERE n >= 20"""


@query("dagostino", _dagostino_sql("events", "value") + "\nUNION ALL\n" + _dagostino_sql("lineitem", "l_discount"))
def dagostino(spark, sf):
    """H8 on event values and line discounts."""
    a = T.dagostino_pearson(t(spark, sf, "events"), ["value"])
    b = T.dagostino_pearson(t(spark, sf, "lineitem"), ["l_discount"])
    return round_cols(a.unionByName(b))


TWO_GROUPS_SQL = """
WITH top AS (SELECT event_type AS g, count(*) AS c FROM events WHERE event_type IS NOT NULL GROUP BY 1
             ORDER BY c DESC, g LIMIT 2),
g1 AS (SELECT g FROM top ORDER BY c DESC, g LIMIT 1),
sub AS (SELECT event_type AS g, value AS x FROM events WHERE event_type IN (SELECT g FROM top) AND value IS NOT NULL)
"""


@query("t_statistic", TWO_GROUPS_SQL + """
, s AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM sub GROUP BY g)
SELECT 'value' AS value, 'event_type' AS category, a.g AS group1, b.g AS group2, round(a.m, 6) AS group1_mean,
  round(b.m, 6) AS group2_mean, a.n AS group1_size, b.n AS group2_size,
  round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS statistic
FROM s a, s b WHERE a.g = (SELECT g FROM g1) AND b.g <> a.g""")
def t_statistic(spark, sf):
    """H12 (statistic; the p-value needs the t CDF and is checked in unit tests)."""
    r = T.t_test(t(spark, sf, "events"), "value", "event_type")
    return round_cols(r.drop("p_value", "significant"))


@query("mann_whitney_u", TWO_GROUPS_SQL + """
, r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM sub)
SELECT 'value' AS value, 'event_type' AS category, (SELECT g FROM g1) AS group1,
  (SELECT g FROM top WHERE g <> (SELECT g FROM g1)) AS group2,
  round(sum(rk) - count(*) * (count(*) + 1) / 2.0, 6) AS u_statistic
FROM r WHERE g = (SELECT g FROM g1)""")
def mann_whitney_u(spark, sf):
    """H13 (U of the first group; p checked in unit tests)."""
    r = T.mann_whitney(t(spark, sf, "events"), "value", "event_type")
    return round_cols(r.drop("p_value", "significant"))


# The inverse of the normal distribution function of a probability p in SQL: a rational
# start and three Halley steps; the tail by series and continued fraction.
_TAIL = ("(CASE WHEN {z} < 3 THEN 0.5 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * list_reduce(list_prepend(1.0::DOUBLE, list_reverse(range(1, 60))), "
         "lambda acc, k: 1.0 + {z} * {z} / (2 * k + 1) * acc) ELSE exp(-{z} * {z} / 2) / sqrt(2 * pi()) / "
         "list_reduce(list_prepend({z}, list_reverse(range(1, 121))), lambda acc, k: {z} + k / acc) END)")


def _halley(name, source, z):
    off = f"(({_TAIL.format(z=z)} - low) / (exp(-{z} * {z} / 2) / sqrt(2 * pi())))"
    return f"{name} AS (SELECT *, {z} + {off} / (1 - {z} * {off} / 2) AS {name}z FROM {source})"


@query("shapiro_statistic", f"""
WITH v AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice) AS i, count(*) OVER () AS n FROM part WHERE p_retailprice IS NOT NULL),
q AS (SELECT x, i, n, least((i - 0.375) / (n + 0.25), 1 - (i - 0.375) / (n + 0.25)) AS low,
             CASE WHEN (i - 0.375) / (n + 0.25) < 0.5 THEN -1 ELSE 1 END AS side FROM v),
a0 AS (SELECT *, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS a0z
       FROM (SELECT *, sqrt(-2 * ln(low)) AS t FROM q)),
{_halley("a1", "a0", "a0z")}, {_halley("a2", "a1", "a1z")}, {_halley("a3", "a2", "a2z")},
m AS (SELECT x, i, n, side * a3z AS m FROM a3),
s AS (SELECT max(n) AS n, sum(m * m) AS mm, max(m) AS last, max(m) FILTER (WHERE i = n - 1) AS second, sum((x - mean) * (x - mean)) AS ss
      FROM m, (SELECT avg(x) AS mean FROM m)),
e AS (SELECT *, last / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS an,
             second / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS an1
      FROM (SELECT *, 1 / sqrt(n) AS u FROM s)),
f AS (SELECT *, sqrt((mm - 2 * last ** 2 - 2 * second ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)) AS d FROM e),
b AS (SELECT sum(x * CASE WHEN m.i = 1 THEN -an WHEN m.i = m.n THEN an WHEN m.i = 2 THEN -an1 WHEN m.i = m.n - 1 THEN an1 ELSE m / d END) AS b, any_value(f.n) AS n, any_value(ss) AS ss FROM m, f)
SELECT 'p_retailprice' AS column, n, round(b * b / ss, 8) AS statistic FROM b""")
def shapiro_statistic(spark, sf):
    """H7: W of part's retail price."""
    r = T.shapiro_wilk(t(spark, sf, "part"), "p_retailprice")
    return r.select("column", "n", F.round("statistic", 8).alias("statistic"))


@query("shapiro_wilk")
def shapiro_wilk(spark, sf):
    """H7 on part's retail price when 8 <= n <= 5000 (rows-only)."""
    return round_cols(T.shapiro_wilk(t(spark, sf, "part"), "p_retailprice"))


def _log_cdf(z):
    """log of the normal distribution function of a SQL expression: power series in
    the middle, continued fraction in the tails."""
    tail = f"list_reduce(list_prepend(abs({z}), list_reverse(range(1, 61))), lambda acc, k: abs({z}) + k / acc)"
    log_tail = f"(-{z} * {z} / 2 - 0.5 * ln(2 * pi()) - ln({tail}))"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, list_reverse(range(1, 46))), lambda acc, k: 1.0 + {z} * {z} / (2 * k + 1) * acc)"
    middle = f"ln(0.5 + exp(-{z} * {z} / 2 - 0.5 * ln(2 * pi())) * {z} * {series})"
    return f"(CASE WHEN {z} < -3 THEN {log_tail} WHEN {z} > 3 THEN ln(1 - exp({log_tail})) ELSE {middle} END)"


_Z = """z AS (SELECT (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z, row_number() OVER (ORDER BY value) AS i,
  count(*) OVER () AS n FROM events WHERE value IS NOT NULL)"""


@query("anderson_darling", f"""
WITH {_Z}, l AS (SELECT i, n, {_log_cdf('z')} AS lo, {_log_cdf('(-z)')} AS hi FROM z),
a AS (SELECT any_value(n) AS n, -any_value(n) - sum((2 * i - 1) * lo + (2 * (n - i) + 1) * hi) / any_value(n) AS a2 FROM l)
SELECT 'value' AS column, n, round(a2, 4) AS statistic, round(0.787 / (1 + 4.0 / n - 25.0 / (n * n)), 6) AS critical_value,
  a2 < 0.787 / (1 + 4.0 / n - 25.0 / (n * n)) AS is_normal FROM a WHERE n >= 8""")
def anderson_darling(spark, sf):
    """H9 on the event value."""
    return round_cols(T.anderson_darling(t(spark, sf, "events"), "value"), {"statistic": 4})


@query("ks_statistic", f"""
WITH {_Z}, p AS (SELECT i, n, exp({_log_cdf('z')}) AS p FROM z)
SELECT 'value' AS column, any_value(n) AS n, round(max(greatest(i / n - p, p - (i - 1) / n)), 6) AS statistic FROM p""")
def ks_statistic(spark, sf):
    """The statistic (its p-value needs the Kolmogorov distribution)."""
    return round_cols(T.ks_normal(t(spark, sf, "events"), "value").select("column", "n", "statistic"))


@query("ks_normal")
def ks_normal(spark, sf):
    """H10 on the event value (rows-only)."""
    return round_cols(T.ks_normal(t(spark, sf, "events"), "value"))
