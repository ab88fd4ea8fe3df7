"""Trend and time-series operators.

Series order comes from a timestamp plus a tie-breaker column: Spark keeps no
file order, so "consecutive rows" needs an explicit total order.  Positions
and lags come from range buckets (``order``), with no single-task window and no self-join.  Daily series are aggregated first; windows
over days are fine because a calendar is small (36 500 rows per century).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions import special
from gridscope.functions.columns import c, epoch_micros, epoch_seconds, num, safe_corr
from gridscope.operators.order import dense_position, with_halo, with_lags
from gridscope.session import materialize

DAY = 86_400.0


def _micros(df, name):
    return epoch_micros(df, name)


def linear_trend(df: DataFrame, ts: str, ycols: list[str], min_rows: int = 10) -> DataFrame:
    """G1: per value column the least-squares slope against time (per day),
    r², correlation, two-sided p (Student t, n - 2 df), n and span in days.
    ``stable`` when |slope| < 0.1 * std(y), else increasing / decreasing.
    One aggregate for all columns; the p-value is a driver-side scalar."""
    x = epoch_seconds(df, ts) / DAY
    rows = []
    for y in ycols:
        yy = num(df, y)
        ok = c(ts).isNotNull() & yy.isNotNull()
        xv, yv = F.when(ok, x), F.when(ok, yy)
        rows.append(F.struct(
            F.lit(y).alias("column"), F.regr_slope(yv, xv).alias("slope"),
            F.regr_r2(yv, xv).alias("r_squared"), safe_corr(xv, yv).alias("correlation"),
            F.regr_count(yv, xv).alias("n"), F.stddev_samp(yv).alias("_std"),
            F.floor((F.max(F.when(ok, _micros(df, ts))) - F.min(F.when(ok, _micros(df, ts)))) / 86_400_000_000)
            .cast("long").alias("time_span_days")))
    res = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rows)]).select(
        F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rows))])))
    res = res.filter(F.col("n") >= min_rows)
    trend = (F.when(F.abs("slope") < F.col("_std") * 0.1, "stable")
             .when(F.col("slope") > 0, "increasing").otherwise("decreasing"))
    r = F.col("correlation")
    tstat = r * F.sqrt((F.col("n") - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return res.select("column", trend.alias("trend_type"), "slope", "r_squared", "correlation",
                      tstat.alias("t_statistic"), "n", "time_span_days")


def add_p_values(df: DataFrame, t_col: str = "t_statistic", n_col: str = "n", alpha: float = 0.05) -> DataFrame:
    """Two-sided Student-t p-values for a small result table (one Python call
    per result row, on the driver-sized table)."""
    rows = df.collect()
    spark = df.sparkSession
    out = []
    for r in rows:
        d = r.asDict()
        t, n = d[t_col], d[n_col]
        p = special.t_two_sided(t, n - 2) if t is not None and n and n > 2 else None
        if t is not None and math.isinf(t):
            p = 0.0
        d["p_value"] = p
        d["significant"] = (p is not None and p < alpha)
        out.append(d)
    schema = df.schema.add("p_value", "double").add("significant", "boolean")
    return spark.createDataFrame([tuple(d[f.name] for f in schema.fields) for d in out], schema)


def _timed(df: DataFrame, ts: str, tie: str, value: str) -> DataFrame:
    """Rows with a non-null time, tie-breaker and value."""
    return df.select(c(ts).alias("_ts"), c(tie).alias("_tie"), num(df, value).alias("_y")).dropna()


def positions(df: DataFrame, ts: str, tie: str, value: str) -> DataFrame:
    """Rows with a non-null time and value, numbered 0.. in (ts, tie) order."""
    return dense_position(_timed(df, ts, tie, value), ["_ts", "_tie"], out="pos")


def index_trend(df: DataFrame, ts: str, tie: str, value: str) -> DataFrame:
    """Slope of the value over its row index in time order;
    < 3 rows insufficient_data, |slope| < 0.01 stable."""
    p = positions(df, ts, tie, value)
    agg = p.agg(F.regr_slope("_y", F.col("pos").cast("double")).alias("slope"), F.count(F.lit(1)).alias("n"))
    label = (F.when(F.col("n") < 3, "insufficient_data").when(F.abs("slope") < 0.01, "stable")
             .when(F.col("slope") > 0, "increasing").otherwise("decreasing"))
    return agg.select(F.lit(value).alias("column"), "n", "slope", label.alias("trend"))


def resample_daily(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean per calendar day, every day between the first and the last
    present (missing days have a NULL mean).  The calendar is generated by
    ``sequence`` from the two bounds and left-joined."""
    d = df.select(F.to_date(c(ts)).alias("day"), num(df, value).alias("_y")).filter(
        F.col("day").isNotNull() & F.col("_y").isNotNull())
    daily = d.groupBy("day").agg(F.avg("_y").alias("mean"), F.count("_y").alias("n"))
    cal = daily.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return cal.join(daily, "day", "left")


def seasonal_strength(df: DataFrame, ts: str, value: str, period: int = 7,
                      min_rows: int = 24, min_days: int = 14) -> DataFrame:
    """Additive decomposition of the daily mean series with a centred
    moving average trend (width ``period``) and a seasonal part averaged by
    position mod ``period``.  Strengths = population variance of the part /
    population variance of the raw values.  A missing calendar day makes the
    decomposition undefined: strengths NULL and ``note`` says why."""
    raw = df.select(num(df, value).alias("_y"), c(ts).alias("_t")).dropna()
    raw_stats = raw.agg(F.count(F.lit(1)).alias("rows"), F.var_pop("_y").alias("raw_var"))
    days = resample_daily(df, ts, value)
    first = days.agg(F.min("day").alias("_d0"))
    half = period // 2
    w = Window.orderBy("p").rowsBetween(-half, half)  # over days: a small, aggregated table
    s = (days.crossJoin(first).withColumn("p", F.datediff("day", "_d0"))
         .withColumn("_cnt", F.count("mean").over(w))
         .withColumn("trend", F.when(F.col("_cnt") == period, F.avg("mean").over(w)))
         .withColumn("detr", F.col("mean") - F.col("trend"))
         .withColumn("k", F.col("p") % period))
    per = s.groupBy("k").agg(F.avg("detr").alias("_pa"))
    per = per.withColumn("seasonal", F.col("_pa") - F.avg("_pa").over(Window.partitionBy(F.lit(1))))
    s = s.join(F.broadcast(per.select("k", "seasonal")), "k", "left").withColumn(
        "resid", F.col("mean") - F.col("trend") - F.col("seasonal"))
    parts = s.agg(F.count(F.lit(1)).alias("days"), F.count("mean").alias("days_present"),
                  F.var_pop("seasonal").alias("sv"), F.var_pop("trend").alias("tv"), F.var_pop("resid").alias("rv"))
    j = parts.crossJoin(raw_stats)
    ok = (F.col("days") == F.col("days_present")) & (F.col("rows") >= min_rows) & (F.col("days") >= min_days)
    note = (F.when(F.col("rows") < min_rows, "too_few_rows").when(F.col("days") < min_days, "too_few_days")
            .when(F.col("days") != F.col("days_present"), "missing_days").otherwise("ok"))
    return j.select(F.lit(value).alias("column"), "rows", "days",
                    F.when(ok, F.try_divide(F.col("sv"), F.col("raw_var"))).alias("seasonal_strength"),
                    F.when(ok, F.try_divide(F.col("tv"), F.col("raw_var"))).alias("trend_strength"),
                    F.when(ok, F.try_divide(F.col("rv"), F.col("raw_var"))).alias("residual_strength"),
                    note.alias("note"))


def sort_by_time(df: DataFrame, ts: str, tie: str | None = None) -> DataFrame:
    """Rows in time order (a range-partitioned global sort)."""
    return df.orderBy(c(ts), *([c(tie)] if tie else []))


def centred_moving_average(daily: DataFrame, day: str = "day", value: str = "mean", width: int = 7) -> DataFrame:
    """E6 over a calendar table: the centred mean of ``width`` days, NULL
    unless the whole window has values.  The input is one row per day."""
    half = width // 2
    w = Window.orderBy(day).rowsBetween(-half, half)  # days: a small, aggregated table
    return daily.withColumn("_cnt", F.count(value).over(w)).withColumn(
        "moving_average", F.when(F.col("_cnt") == width, F.avg(value).over(w))).drop("_cnt")


def series_summary(df: DataFrame, ts: str, ycols: list[str], min_rows: int = 20) -> DataFrame:
    """G5 + G10: length, first and last time, missing values (0 after the
    pairwise drop) for each value column with at least ``min_rows`` rows."""
    long = df.select(c(ts).alias("_ts"), F.inline(F.array(*[
        F.struct(F.lit(y).alias("column"), num(df, y).alias("_y")) for y in ycols])))
    ok = F.col("_ts").isNotNull() & F.col("_y").isNotNull()
    out = long.groupBy("column").agg(
        F.count_if(ok).alias("length"), F.min(F.when(ok, F.col("_ts"))).alias("start"),
        F.max(F.when(ok, F.col("_ts"))).alias("end"), F.lit(0).cast("long").alias("missing_values"))
    return out.filter(F.col("length") >= min_rows)


def consecutive_gaps(df: DataFrame, ts: str) -> DataFrame:
    """Differences (seconds) between consecutive sorted times with their
    multiplicity ``(gap_s, count)``.  Works on distinct times only: equal
    times give ``count - 1`` zero gaps; distinct neighbours meet inside their range
    bucket, so no window holds the whole series."""
    t = df.select(_micros(df, ts).alias("_m")).filter(F.col("_m").isNotNull())
    vc = t.groupBy("_m").agg(F.count(F.lit(1)).alias("cnt"))
    zeros = vc.agg(F.lit(0.0).alias("gap_s"), F.sum(F.col("cnt") - 1).alias("count"))
    j = with_lags(vc.select("_m"), ["_m"], ["_m"])
    gaps = (j.filter(F.col("_m_lag1").isNotNull())
            .select(((F.col("_m") - F.col("_m_lag1")) / 1e6).alias("gap_s"))
            .groupBy("gap_s").agg(F.count(F.lit(1)).alias("count")))
    return gaps.unionByName(zeros.filter(F.col("count") > 0))


def _mode_gap(df: DataFrame, ts: str) -> DataFrame:
    g = consecutive_gaps(df, ts)
    return g.agg(F.min_by("gap_s", F.struct(F.negative("count"), F.col("gap_s"))).alias("mode_gap_s"),
                 F.sum("count").alias("n_gaps"))


def series_frequency(df: DataFrame, ts: str) -> DataFrame:
    """The most common gap (smallest on ties): <= 1 day daily, <= 7
    weekly, <= 31 monthly, <= 365 yearly, else irregular."""
    m = _mode_gap(df, ts)
    g = F.col("mode_gap_s") / DAY
    lab = (F.when(F.col("n_gaps").isNull() | (F.col("n_gaps") == 0), "unknown")
           .when(g <= 1, "daily").when(g <= 7, "weekly").when(g <= 31, "monthly").when(g <= 365, "yearly")
           .otherwise("irregular"))
    return m.select("mode_gap_s", lab.alias("frequency"))


def date_frequency(df: DataFrame, ts: str) -> DataFrame:
    """Whole days of the most common gap: 1 daily, 6-8 weekly, 28-31
    monthly, 88-95 quarterly, 360-370 yearly, otherwise irregular; fewer than
    2 dates insufficient_data."""
    m = _mode_gap(df, ts)
    n = df.agg(F.count(c(ts)).alias("_n"))
    d = F.floor(F.col("mode_gap_s") / DAY)
    lab = (F.when(F.col("_n") < 2, "insufficient_data").when(d == 1, "daily")
           .when(d.between(6, 8), "weekly").when(d.between(28, 31), "monthly")
           .when(d.between(88, 95), "quarterly").when(d.between(360, 370), "yearly").otherwise("irregular"))
    return m.crossJoin(n).select(F.col("mode_gap_s"), lab.alias("frequency_pattern"))


def autocovariances(df: DataFrame, ts: str, tie: str, value: str, max_lag: int | None = None) -> tuple[list[float], int]:
    """Biased sums sum_t (x_t - m)(x_{t-k} - m) for k = 0..L and n: every row meets
    its predecessors inside its range bucket, and one aggregate adds the products."""
    base = _timed(df, ts, tie, value)
    st = base.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m")).first()
    n, m = st["n"], st["m"]
    if not n:
        return [], 0
    lags = max_lag if max_lag is not None else min(20, n // 4)
    d = base.select("_ts", "_tie", (F.col("_y") - F.lit(m)).alias("d"))
    rows = with_lags(d, ["_ts", "_tie"], ["d"], lags) if lags else d
    products = [F.sum(F.col("d") * F.col("d")), *[F.sum(F.col("d") * F.col(f"d_lag{k}")) for k in range(1, lags + 1)]]
    sums = rows.agg(*[x.alias(f"s{k}") for k, x in enumerate(products)]).first()
    return [float(x or 0.0) for x in sums], n


def acf(df: DataFrame, ts: str, tie: str, value: str, threshold: float = 0.2) -> DataFrame:
    """Autocorrelation for lags 0..min(20, n // 4) (biased estimator) and
    whether |r| > ``threshold`` (lag 0 included, as in the reference)."""
    sums, n = autocovariances(df, ts, tie, value)
    spark = df.sparkSession
    rows = [(k, s / sums[0], abs(s / sums[0]) > threshold) for k, s in enumerate(sums)] if sums and sums[0] else []
    return spark.createDataFrame(rows, "lag int, acf double, significant boolean")


def pacf(df: DataFrame, ts: str, tie: str, value: str) -> DataFrame:
    """Partial autocorrelation by Yule-Walker with the adjusted
    (n - k) autocovariance, Durbin-Levinson recursion on the <= 21 sums."""
    sums, n = autocovariances(df, ts, tie, value)
    spark = df.sparkSession
    if not sums:
        return spark.createDataFrame([], "lag int, pacf double")
    r = np.array([s / (n - k) for k, s in enumerate(sums)])
    rho = r / r[0]
    out = [(0, 1.0)]
    phi_prev = np.array([])
    for k in range(1, len(rho)):
        if k == 1:
            phi_kk = rho[1]
            phi = np.array([phi_kk])
        else:
            num = rho[k] - np.dot(phi_prev, rho[1:k][::-1])
            den = 1.0 - np.dot(phi_prev, rho[1:k])
            phi_kk = num / den
            phi = np.append(phi_prev - phi_kk * phi_prev[::-1], phi_kk)
        out.append((k, float(phi_kk)))
        phi_prev = phi
    return spark.createDataFrame(out, "lag int, pacf double")


def durbin_watson_in_order(df: DataFrame, order: list[str], resid: str) -> DataFrame:
    """H6 on any residual table: sum (e_t - e_{t-1})^2 / sum e_t^2 in ``order``."""
    j = with_lags(df, order, [resid])
    return j.agg((F.sum((c(resid) - F.col(f"`{resid}_lag1`")) ** 2) / F.sum(c(resid) ** 2)).alias("durbin_watson"))


# ------------------------------------------------------------------ ADF test

# MacKinnon (1994) p-value surface and MacKinnon (2010) critical
# value polynomials for the constant-only regression with one series.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_CRIT = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
            "5%": [-2.86154, -2.8903, -4.234, -40.040],
            "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def _mackinnon_p(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL_P if stat <= ADF_TAU_STAR else ADF_LARGE_P
    return special.norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def _lag_sums(width: int):
    """Sums over the rows of a partition, which come in order of (bucket, position): for
    every lag h = 0..``width`` the products d_t d_{t-h} and x_{t-1} d_{t-h}, d being the
    differences.  Rows marked ``halo`` only serve as predecessors; before the series'
    second row a difference counts as 0.  One dot product per lag and batch; what is
    held between batches is ``width`` numbers."""
    import pyarrow as pa

    def run(batches):
        dd, xd = np.zeros(width + 1), np.zeros(width + 1)
        bucket, last, before = None, None, np.zeros(width)
        for b in batches:
            at, x = b.column("_gs_b").to_numpy(), b.column("x").to_numpy()
            own = ~b.column("halo").to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                if not len(part):
                    continue
                if at[part[0]] != bucket:
                    bucket, last, before = at[part[0]], None, np.zeros(width)
                xs = x[part]
                prev = np.concatenate([[0.0 if last is None else last], xs[:-1]])
                d = xs - prev
                if last is None:
                    d[0] = 0.0
                line = np.concatenate([before, d])
                first = int(np.argmax(own[part])) if own[part].any() else len(part)  # halo rows come first
                if first < len(part):
                    mine, level = d[first:], prev[first:]
                    for h in range(width + 1):
                        shifted = line[width + first - h:len(line) - h]
                        dd[h] += mine @ shifted
                        xd[h] += level @ shifted
                last, before = xs[-1], line[len(line) - width:]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(dd), pa.array(xd)], names=["lag", "dd", "xd"])

    return run


class LagGrams:
    """Cross products of [1, x_{t-1}, d_{t-1}, .., d_{t-p}, d_t] over t = p + 1 .. n - 1 for
    any p up to ``width``, from lag sums over the whole series and its two ends.

    The product of two lagged differences depends on their distance alone, but for
    the few terms at either end of the series; products with the constant telescope."""

    def __init__(self, n: int, total: float, squares: float, dd, xd, head, tail):
        self.n, self.total, self.squares = n, total, squares
        self.dd, self.xd, self.head, self.tail = dd, xd, np.asarray(head), np.asarray(tail)
        self.first, self.final = np.diff(self.head), np.diff(self.tail)  # d_1 .., .. d_{n-1}

    def gram(self, p: int) -> np.ndarray:
        g = np.zeros((p + 3, p + 3))
        g[0, 0] = self.n - 1 - p
        g[0, 1] = self.total - self.head[:p].sum() - self.tail[-1]
        g[1, 1] = self.squares - self.head[:p] @ self.head[:p] - self.tail[-1] ** 2
        lags = np.empty((p + 1, p + 1))
        newest = self.final[::-1]
        for h in range(p + 1):
            # Row t has d_{t-i} d_{t-i-h}: u = t - i runs from p + 1 - i to n - 1 - i, so the
            # terms u = h + 1 .. p - i at the beginning and the last i at the end are taken off.
            begin = np.concatenate([[0.0], np.cumsum(self.first[h:p] * self.first[:p - h])])
            end = np.concatenate([[0.0], np.cumsum(newest[:p - h] * newest[h:p])])
            i = np.arange(p - h + 1)
            lags[i, i + h] = lags[i + h, i] = self.dd[h] - begin[p - h - i] - end[i]
        level = [self.xd[j] - self.head[j:p] @ self.first[:p - j] for j in range(p + 1)]  # but for t = j + 1 .. p
        constant = [self.tail[-1 - j] - self.head[p - j] for j in range(p + 1)]
        order = [*range(1, p + 1), 0]  # d_t stands last
        g[2:, 2:] = lags[np.ix_(order, order)]
        g[0, 2:], g[1, 2:] = np.take(constant, order), np.take(level, order)
        return np.triu(g) + np.triu(g, 1).T


def lag_grams(base: DataFrame, order: list[str], n: int, width: int) -> LagGrams:
    """``LagGrams`` of the column ``x`` in ``order``.  What tasks hand on grows with their
    number and ``width`` alone; 2 (``width`` + 1) values of the series are collected."""
    mean = base.agg(F.avg("x")).first()[0]
    rows = with_halo(base.withColumn("x", F.col("x") - F.lit(mean)), order, width + 1).select("_gs_b", "pos", "halo", "x")
    rows = materialize(rows, "lagged")
    dealt = rows.repartition("_gs_b").sortWithinPartitions("_gs_b", "pos")
    sums = dealt.mapInArrow(_lag_sums(width), "lag long, dd double, xd double").groupBy("lag").agg(
        F.sum("dd").alias("dd"), F.sum("xd").alias("xd")).orderBy("lag").collect()
    own = rows.filter("NOT halo")
    st = own.agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).first()
    ends = own.filter((F.col("pos") <= width) | (F.col("pos") >= n - 1 - width)).select("pos", "x").collect()
    by = {r["pos"]: r["x"] for r in ends}
    return LagGrams(n, st["s"], st["q"], [r["dd"] for r in sums], [r["xd"] for r in sums],
                    [by[k] for k in range(min(width + 1, n))], [by[k] for k in range(max(0, n - 1 - width), n)])


def _nested_residuals(g: np.ndarray) -> np.ndarray:
    """Residual sums of squares of regressing the last column on the first k, for every
    k: one triangular factor of the whole matrix holds them all."""
    k = len(g) - 1
    scale = np.sqrt(np.diag(g))
    if not scale.all():
        raise np.linalg.LinAlgError("a column without variation")
    low = np.linalg.cholesky(g[:k, :k] / np.outer(scale[:k], scale[:k]))
    part = np.linalg.solve(low, g[:k, k] / scale[:k])
    return g[k, k] - np.cumsum(part * part)


def adf_test(df: DataFrame, ts: str, tie: str, value: str, max_lag: int | None = None, search: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller with a constant and the lag chosen by AIC up to
    ``max_lag`` (by default K = 12 (n/100)^(1/4), as the reference's library does), or
    exactly ``max_lag`` lags without ``search``.

    Rows lie in range buckets in (ts, tie) order, each with the K + 1 rows before it.
    Per lag two sums of products are added up over all rows; these and the ends of the
    series give the cross products of every regression (``LagGrams``), and one triangular
    factor gives the residuals of all nested ones.  Fewer than four rows give no
    result, a series without variation or with too few rows for its lags NULLs."""
    spark = df.sparkSession
    schema = ("column string, adf_statistic double, p_value double, used_lag int, nobs long, "
              "crit_1 double, crit_5 double, crit_10 double, is_stationary boolean")
    base = _timed(df, ts, tie, value).withColumnRenamed("_y", "x")
    n = base.count()
    if n < 4:
        return spark.createDataFrame([], schema)
    K = int(math.ceil(12.0 * (n / 100.0) ** 0.25)) if max_lag is None else max_lag
    K = max(0, min(n // 2 - 2, K))
    none = spark.createDataFrame([(value, None, None, None, n, None, None, None, None)], schema)
    grams = lag_grams(base, ["_ts", "_tie"], n, K)
    try:
        best = K
        if search:
            ssr = np.maximum(_nested_residuals(grams.gram(K))[1:], 1e-300)
            rows = n - 1 - K
            aic = rows * (math.log(2 * math.pi) + np.log(ssr / rows) + 1) + 2 * (np.arange(K + 1) + 2)
            best = int(np.argmin(aic))
        g = grams.gram(best)
        k = best + 2
        beta = np.linalg.solve(g[:k, :k], g[:k, k])
        nobs = n - 1 - best
        s2 = max(float(g[k, k] - beta @ g[:k, k]), 1e-300) / (nobs - k)
        stat = float(beta[1] / math.sqrt(s2 * np.linalg.inv(g[:k, :k])[1, 1]))
    except (np.linalg.LinAlgError, ZeroDivisionError, ValueError):
        return none
    if not math.isfinite(stat):
        return none
    pval = _mackinnon_p(stat)
    crit = {key: sum(cc / nobs ** i for i, cc in enumerate(v)) for key, v in ADF_CRIT.items()}
    return spark.createDataFrame([(value, stat, pval, best, nobs, crit["1%"], crit["5%"], crit["10%"], pval < 0.05)],
                                 schema)
