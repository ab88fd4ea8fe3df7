"""Normality and two-sample tests.

Test statistics are Spark aggregates (moments, rank sums, sums over value
counts).  Only the final tail probabilities are evaluated on the driver, on a
few scalars.  Order statistics (Shapiro-Wilk, Anderson-Darling) work on
distinct values with their running counts, so ties and hot values cost one
row each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions import special
from gridscope.functions.columns import c, num
from gridscope.operators.order import cumulative, value_counts_long


def _values(df: DataFrame, col: str) -> DataFrame:
    return df.select(num(df, col).alias("x")).filter(F.col("x").isNotNull())


def dagostino_expr(n, g1, b2):
    """K² and p of D'Agostino-Pearson from n, population skewness g1 and
    Pearson kurtosis b2 (= excess + 3), as Column expressions."""
    y = g1 * F.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.ln(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    z1 = delta * F.ln(y / alpha + F.sqrt((y / alpha) ** 2 + 1))
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.cbrt((1 - 2.0 / a) / denom)
    z2 = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    return z1, z2, k2, F.exp(-k2 / 2)


def dagostino_pearson(df: DataFrame, cols: list[str], min_rows: int = 20, alpha: float = 0.05) -> DataFrame:
    """H8: omnibus K² = Z(skew)² + Z(kurt)², p = exp(-K²/2) (chi-square, 2 df).
    One aggregate of moments for all columns, then closed-form column expressions."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), num(df, x).alias("x")) for x in cols])))
    m = long.groupBy("column").agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"), (F.kurtosis("x") + 3).alias("b2"))
    z1, z2, k2, p = dagostino_expr(F.col("n"), F.col("g1"), F.col("b2"))
    return m.filter(F.col("n") >= min_rows).select(
        "column", F.col("n").cast("long").alias("n"), z1.alias("z_skew"), z2.alias("z_kurt"), k2.alias("statistic"),
        p.alias("p_value"), (p > alpha).alias("is_normal"))


def _ordered_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with count and the count of all smaller values (``s``)."""
    vc = value_counts_long(_values(df, col), "x")
    cum = cumulative(vc, ["x"], weight="cnt", out="_c")
    return cum.withColumn("s", F.col("_c") - F.col("cnt")).drop("_c")


def log_normal_cdf(z: Column) -> Column:
    """log of the standard normal distribution function, as a column expression:
    the power series in the middle, Laplace's continued fraction in the tails
    (where the log is taken of its parts, so that nothing underflows)."""
    half_log = 0.5 * math.log(2 * math.pi)
    series = F.lit(1.0)
    for k in range(45, 0, -1):  # z + z^3/3 + z^5/15 + ...
        series = 1.0 + z * z / (2 * k + 1) * series
    far = F.abs(z)
    tail = far
    for k in range(60, 0, -1):  # z + 1/(z + 2/(z + ...))
        tail = far + k / tail
    log_tail = -z * z / 2 - half_log - F.log(tail)
    middle = F.log(0.5 + F.exp(-z * z / 2 - half_log) * z * series)
    return F.when(z < -3, log_tail).when(z > 3, F.log1p(-F.exp(log_tail))).otherwise(middle)


def anderson_darling(df: DataFrame, col: str, min_rows: int = 8) -> DataFrame:
    """H9: A² for normality with sample mean / std (ddof 1) and the 5 %
    critical value 0.787 / (1 + 4/n - 25/n²).  The sum over sorted values is
    done over distinct values: a value occupying positions s+1..s+c gets
    weight sum(2j - 1) = (s+c)² - s² on log Φ(z) and the mirrored weight on
    log(1 - Φ(z))."""
    v = _values(df, col)
    st = v.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).first()
    n, m, sd = st["n"], st["m"], st["sd"]
    spark = df.sparkSession
    schema = "column string, n long, statistic double, critical_value double, is_normal boolean"
    if not n or n < min_rows or not sd:
        return spark.createDataFrame([], schema)
    oc = _ordered_counts(df, col)
    oc = oc.withColumn("z", (F.col("x") - F.lit(m)) / F.lit(sd))
    z = F.col("z")
    s, k = F.col("s").cast("double"), F.col("cnt").cast("double")
    w_cdf = (s + k) * (s + k) - s * s
    w_sf = k * (2 * n + 1) - ((s + k) * (s + k + 1) - s * (s + 1))
    tot = oc.select(w_cdf.alias("wc"), w_sf.alias("ws"), log_normal_cdf(z).alias("lcdf"), log_normal_cdf(-z).alias("lsf")).agg(
        F.sum(F.col("wc") * F.col("lcdf") + F.col("ws") * F.col("lsf")).alias("t")).first()["t"]
    a2 = -n - tot / n
    crit = 0.787 / (1.0 + 4.0 / n - 25.0 / (n * n))
    return spark.createDataFrame([(col, n, float(a2), crit, bool(a2 < crit))], schema)


def ks_normal(df: DataFrame, col: str, alpha: float = 0.05, min_rows: int = 8) -> DataFrame:
    """Kolmogorov-Smirnov of the standardized values (ddof 1) against
    N(0, 1) with MLlib's distributed test."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    v = _values(df, col)
    st = v.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n")).first()
    spark = df.sparkSession
    schema = "column string, n long, statistic double, p_value double, is_normal boolean"
    if not st["n"] or st["n"] < min_rows or not st["sd"]:
        return spark.createDataFrame([], schema)
    z = v.select(((F.col("x") - F.lit(st["m"])) / F.lit(st["sd"])).alias("z"))
    r = KolmogorovSmirnovTest.test(z, "z", "norm", 0.0, 1.0).first()
    return spark.createDataFrame([(col, st["n"], float(r.statistic), float(r.pValue), bool(r.pValue > alpha))], schema)


def _swilk_ends(n: int, last: float, second: float, mm: float) -> tuple[float, float, float]:
    """Royston's (1995, AS R94) weights of the largest and second largest value and
    the divisor of all other normal scores (``last``, ``second``: the largest
    scores; ``mm``: the sum of all squared scores)."""
    u = 1.0 / math.sqrt(n)
    # AS R94 polynomial coefficients for the last two weights
    an = last / math.sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5
    if n <= 5:
        return an, second / math.sqrt((mm - 2 * last ** 2) / (1 - 2 * an ** 2)), math.sqrt((mm - 2 * last ** 2) / (1 - 2 * an ** 2))
    an1 = second / math.sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5
    return an, an1, math.sqrt((mm - 2 * last ** 2 - 2 * second ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2))


def normal_scores(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function: Halley steps on a rational start,
    whole arrays at a time, to about 1e-15 of the standard deviation."""
    p = np.asarray(p, float)
    low = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(low))
    # Abramowitz and Stegun 26.2.23, good to 4.5e-4
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t ** 2) / (1 + 1.432788 * t + 0.189269 * t ** 2 + 0.001308 * t ** 3)
    for _ in range(3):  # z is the upper quantile of ``low``
        off = (_upper_tail(z) - low) / (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        z = z + off / (1 - z * off / 2)
    return np.where(p < 0.5, -z, z)


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Chance of more than z >= 0: power series near 0, continued fraction beyond."""
    z = np.maximum(z, 0.0)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    near = np.minimum(z, 3.0)
    term = total = near.copy()
    for k in range(1, 60):
        term = term * near * near / (2 * k + 1)
        total = total + term
    far = np.maximum(z, 3.0)
    fraction = far.copy()
    for k in range(120, 0, -1):
        fraction = far + k / fraction
    return np.where(z < 3.0, 0.5 - density * total, density / fraction)


#: Positions whose scores are computed one by one at either end of a stretch; between
#: them sums are integrals.
EXACT = 4_096
#: Nodes and weights of the rule that integrates a smooth stretch.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def score_sums(start: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of positions start+1..start+count (of n) the sum of the normal
    scores and of their squares, without the two positions at either end of all.

    Short stretches are added up, one array for all of them.  The inside of a long one
    is an integral with end corrections (Euler-Maclaurin), cut where the scores bend."""
    lo = np.maximum(start + 1, 3).astype(np.int64)
    hi = np.minimum(start + count, n - 2).astype(np.int64)
    sums, squares = np.zeros(len(lo)), np.zeros(len(lo))
    size = np.maximum(hi - lo + 1, 0)
    short = np.flatnonzero((size > 0) & (size <= 2 * EXACT))
    for part in np.array_split(short, max(1, int(size[short].sum()) // 2_000_000 + 1)):
        if len(part):
            n_each = size[part]
            owner = np.repeat(np.arange(len(part)), n_each)
            at = np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each) + lo[part][owner]
            m = normal_scores((at - 0.375) / (n + 0.25))
            sums[part], squares[part] = np.bincount(owner, m, len(part)), np.bincount(owner, m * m, len(part))
    for i in np.flatnonzero(size > 2 * EXACT):
        sums[i], squares[i] = _long_sum(int(lo[i]), int(hi[i]), n)
    return sums, squares


def _long_sum(lo: int, hi: int, n: int) -> tuple[float, float]:
    a, b = lo + EXACT, hi - EXACT  # positions a..b by integral, the others one by one
    ends = normal_scores((np.concatenate([np.arange(lo, a), np.arange(b + 1, hi + 1)]) - 0.375) / (n + 0.25))
    # Points of cutting double their distance from either end of all positions.
    cuts = {float(a), float(b)}
    step = 2.0 * EXACT
    while step < n:
        cuts |= {x for x in (step, n - step) if a < x < b}
        step *= 2
    edges = np.array(sorted(cuts))
    half, middle = np.diff(edges) / 2, (edges[1:] + edges[:-1]) / 2
    z = normal_scores((middle[:, None] + half[:, None] * _NODES - 0.375) / (n + 0.25))
    out = []
    za, zb = normal_scores((np.array([a, b]) - 0.375) / (n + 0.25))
    slope = lambda x: math.sqrt(2 * math.pi) * math.exp(x * x / 2) / (n + 0.25)
    for f, d in ((lambda x: x, slope), (lambda x: x * x, lambda x: 2 * x * slope(x))):
        inside = float((f(z) * _WEIGHTS * half[:, None]).sum())
        out.append(inside + (f(za) + f(zb)) / 2 + (d(zb) - d(za)) / 12 + float(f(ends).sum()))
    return out[0], out[1]


def _score_batches(n: int):
    def run(batches):
        for pdf in batches:
            m, mm = score_sums(pdf["s"].to_numpy(np.int64), pdf["cnt"].to_numpy(np.int64), n)
            yield pd.DataFrame({"x": pdf["x"], "s": pdf["s"], "cnt": pdf["cnt"], "m": m, "mm": mm})

    return run


def statistics_nd():
    from statistics import NormalDist
    return NormalDist()


def _swilk_p(w: float, n: int) -> float:
    """Royston's normalizing transformation of W (AS R94)."""
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    # AS R94 coefficients for the mean / sd of the transformed W
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu = 0.544 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)
        if w >= 1 or gamma - math.log1p(-w) <= 0:
            return 1.0
        y = -math.log(gamma - math.log1p(-w))
    else:
        ln = math.log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln ** 2 + 0.0038915 * ln ** 3
        sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln ** 2)
        if w >= 1:
            return 1.0
        y = math.log1p(-w)
    return special.norm_sf((y - mu) / sigma)


def shapiro_wilk(df: DataFrame, col: str, min_rows: int = 8, p_rows: int = 5000, alpha: float = 0.05) -> DataFrame:
    """H7: W at every size; p only up to ``p_rows`` values, the range for which its
    approximation is published (NULL with a note above).  The normal scores of
    the sorted positions are added up per distinct value; those of a frequent value
    are an integral, so no work grows with the rows of one value."""
    spark = df.sparkSession
    schema = "column string, n long, statistic double, p_value double, is_normal boolean, note string"
    v = _values(df, col)
    st = v.agg(F.count("x").alias("n"), F.avg("x").alias("m")).first()
    n, m = st["n"], st["m"]
    if not n or n < min_rows:
        return spark.createDataFrame([], schema)
    oc = _ordered_counts(df, col).select("x", "cnt", "s")
    sums = oc.mapInPandas(_score_batches(n), "x double, s long, cnt long, m double, mm double")
    has = lambda i: F.max(F.when((F.col("s") < i) & (F.col("s") + F.col("cnt") >= i), F.col("x")))
    r = sums.agg(F.sum(F.col("m") * F.col("x")).alias("mx"), F.sum("mm").alias("mm"), has(1).alias("x1"), has(2).alias("x2"),
                 has(n - 1).alias("y2"), has(n).alias("y1")).first()
    nd = statistics_nd()
    last, second = nd.inv_cdf((n - 0.375) / (n + 0.25)), nd.inv_cdf((n - 1.375) / (n + 0.25))
    an, an1, divisor = _swilk_ends(n, last, second, r["mm"] + 2 * last ** 2 + 2 * second ** 2)
    top = an * (r["y1"] - r["x1"]) + an1 * (r["y2"] - r["x2"]) + r["mx"] / divisor
    ss = v.agg(F.sum((F.col("x") - F.lit(m)) ** 2).alias("ss")).first()["ss"]
    w = min(float(top ** 2 / ss), 1.0) if ss else float("nan")
    if n > p_rows:
        return spark.createDataFrame([(col, n, w, None, None, f"no p-value is published for more than {p_rows} values")], schema)
    p = _swilk_p(w, n)
    return spark.createDataFrame([(col, n, w, p, bool(p > alpha), "")], schema)


def normality_consensus(results: list[DataFrame], col: str) -> DataFrame:
    """Tests passed, tests run, likely normal when >= 2 of the 4 pass.  A test
    without a verdict (Shapiro-Wilk above its published range) was not run."""
    spark = results[0].sparkSession
    passed = run = 0
    for r in results:
        rows = r.filter((F.col("column") == col) & F.col("is_normal").isNotNull()).select("is_normal").collect()
        if rows:
            run += 1
            passed += int(bool(rows[0]["is_normal"]))
    return spark.createDataFrame([(col, passed, run, passed >= 2)],
                                 "column string, normal_tests_passed int, total_tests int, likely_normal boolean")


def two_groups(df: DataFrame, value: str, cat: str, min_size: int = 5) -> tuple[DataFrame, list]:
    """Rows of the two most frequent categories (count desc, value asc)."""
    top = (df.filter(c(cat).isNotNull()).groupBy(c(cat).alias("g")).count()
           .orderBy(F.desc("count"), F.asc("g")).limit(2).collect())
    groups = [r["g"] for r in top]
    sub = df.filter(c(cat).isin(groups)).select(c(cat).alias("g"), num(df, value).alias("x")).dropna()
    return sub, groups


def t_test(df: DataFrame, value: str, cat: str, min_size: int = 5) -> DataFrame:
    """Pooled two-sample t between the two most frequent categories
    (each >= 5 values); the statistic is a Spark aggregate, p on the driver."""
    spark = df.sparkSession
    schema = ("value string, category string, group1 string, group2 string, group1_mean double, group2_mean double, "
              "group1_size long, group2_size long, statistic double, p_value double, significant boolean")
    sub, groups = two_groups(df, value, cat)
    if len(groups) < 2:
        return spark.createDataFrame([], schema)
    st = {r["g"]: r for r in sub.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"),
                                                   F.var_samp("x").alias("v")).collect()}
    a, b = st.get(groups[0]), st.get(groups[1])
    if a is None or b is None or a["n"] < min_size or b["n"] < min_size:
        return spark.createDataFrame([], schema)
    n1, n2 = a["n"], b["n"]
    sp2 = ((n1 - 1) * a["v"] + (n2 - 1) * b["v"]) / (n1 + n2 - 2)
    tstat = (a["m"] - b["m"]) / math.sqrt(sp2 * (1 / n1 + 1 / n2)) if sp2 > 0 else float("nan")
    p = special.t_two_sided(tstat, n1 + n2 - 2)
    return spark.createDataFrame([(value, cat, str(groups[0]), str(groups[1]), a["m"], b["m"], n1, n2, tstat, p,
                                   bool(p < 0.05))], schema)


def mann_whitney(df: DataFrame, value: str, cat: str, min_size: int = 5) -> DataFrame:
    """U of the first group with average ranks over the combined sample,
    two-sided p from the normal approximation with tie and continuity
    correction.  Ranks come from distinct values with per-group counts."""
    spark = df.sparkSession
    schema = "value string, category string, group1 string, group2 string, u_statistic double, p_value double, significant boolean"
    sub, groups = two_groups(df, value, cat)
    if len(groups) < 2:
        return spark.createDataFrame([], schema)
    g1 = groups[0]
    vc = sub.groupBy("x").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("g") == F.lit(g1)).alias("c1"))
    cum = cumulative(vc, ["x"], weight="cnt", out="_c")
    avg_rank = F.col("_c") - (F.col("cnt") - 1) / 2.0
    r = cum.agg(F.sum(F.col("c1") * avg_rank).alias("r1"), F.sum("c1").alias("n1"), F.sum("cnt").alias("n"),
                F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt")).alias("ties")).first()
    n1, n = r["n1"], r["n"]
    n2 = n - n1
    if n1 < min_size or n2 < min_size:
        return spark.createDataFrame([], schema)
    u1 = r["r1"] - n1 * (n1 + 1) / 2.0
    u = max(u1, n1 * n2 - u1)
    mu = n1 * n2 / 2.0
    sigma = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - r["ties"] / (n * (n - 1))))
    z = (u - mu - 0.5) / sigma if sigma > 0 else float("nan")
    p = min(1.0, 2 * special.norm_sf(z)) if sigma > 0 else 1.0
    return spark.createDataFrame([(value, cat, str(g1), str(groups[1]), float(u1), p, bool(p < 0.05))], schema)
