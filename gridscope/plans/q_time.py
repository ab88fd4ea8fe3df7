"""Trend and time-series queries (G1-G11) over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import timeseries as G
from gridscope.plans.catalog import query, round_cols, t


@query("linear_trend", """
SELECT 'value' AS column,
  CASE WHEN abs(regr_slope(value, x)) < stddev_samp(value) * 0.1 THEN 'stable'
       WHEN regr_slope(value, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_type,
  round(regr_slope(value, x), 6) AS slope, round(regr_r2(value, x), 6) AS r_squared,
  round(corr(x, value), 6) AS correlation,
  round(corr(x, value) * sqrt((count(*) - 2) / (1 - corr(x, value) * corr(x, value))), 6) AS t_statistic,
  count(*) AS n,
  CAST(floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000) AS BIGINT) AS time_span_days
FROM (SELECT ts, value, epoch_us(ts) / 1e6 / 86400.0 AS x FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
HAVING count(*) >= 10""")
def linear_trend(spark, sf):
    """G1: value against time in days."""
    return round_cols(G.linear_trend(t(spark, sf, "events"), "ts", ["value"]))


@query("index_trend", """
SELECT 'value' AS column, count(*) AS n, round(regr_slope(value, pos), 6) AS slope,
  CASE WHEN count(*) < 3 THEN 'insufficient_data' WHEN abs(regr_slope(value, pos)) < 0.01 THEN 'stable'
       WHEN regr_slope(value, pos) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
FROM (SELECT value, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) AS pos FROM events
      WHERE ts IS NOT NULL AND value IS NOT NULL)""")
def index_trend(spark, sf):
    """Slope over the row index in (ts, event_id) order."""
    return round_cols(G.index_trend(t(spark, sf, "events"), "ts", "event_id", "value"))


@query("daily_resample", """
WITH daily AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean, count(value) AS n FROM events
               WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily)
SELECT strftime(cal.day, '%Y-%m-%d') AS day, round(mean, 6) AS mean, n FROM cal LEFT JOIN daily USING (day)""")
def daily_resample(spark, sf):
    """Calendar of daily means."""
    d = G.resample_daily(t(spark, sf, "events"), "ts", "value")
    return round_cols(d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "mean", "n"))


@query("seasonal_strength", """
WITH raw AS (SELECT value AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
daily AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
s AS (SELECT cal.day, mean, datediff('day', (SELECT min(day) FROM daily), cal.day) AS p FROM cal LEFT JOIN daily USING (day)),
s2 AS (SELECT *, CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END AS trend FROM s
       WINDOW w AS (ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s3 AS (SELECT *, mean - trend AS detr, p % 7 AS k FROM s2),
per AS (SELECT k, avg(detr) AS pa FROM s3 GROUP BY k),
per2 AS (SELECT k, pa - avg(pa) OVER () AS seasonal FROM per),
s4 AS (SELECT s3.*, seasonal, mean - trend - seasonal AS resid FROM s3 JOIN per2 USING (k)),
agg AS (SELECT count(*) AS days, count(mean) AS present, var_pop(seasonal) AS sv, var_pop(trend) AS tv,
               var_pop(resid) AS rv FROM s4),
r AS (SELECT count(*) AS rows, var_pop(y) AS raw_var FROM raw)
SELECT 'value' AS column, rows, days,
  round(CASE WHEN days = present AND rows >= 24 AND days >= 14 THEN sv / raw_var END, 6) AS seasonal_strength,
  round(CASE WHEN days = present AND rows >= 24 AND days >= 14 THEN tv / raw_var END, 6) AS trend_strength,
  round(CASE WHEN days = present AND rows >= 24 AND days >= 14 THEN rv / raw_var END, 6) AS residual_strength,
  CASE WHEN rows < 24 THEN 'too_few_rows' WHEN days < 14 THEN 'too_few_days' WHEN days <> present THEN 'missing_days'
       ELSE 'ok' END AS note
FROM agg, r""")
def seasonal_strength(spark, sf):
    """Weekly additive decomposition strengths of the daily mean value."""
    return round_cols(G.seasonal_strength(t(spark, sf, "events"), "ts", "value"))


@query("series_summary", """
SELECT 'value' AS column, count(*) AS length, min(ts) AS start, max(ts) AS "end", CAST(0 AS BIGINT) AS missing_values
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL HAVING count(*) >= 20""")
def series_summary(spark, sf):
    """G5 + G10."""
    return G.series_summary(t(spark, sf, "events"), "ts", ["value"])


GAPS_SQL = """
WITH d AS (SELECT DISTINCT {c} AS t FROM {tbl} WHERE {c} IS NOT NULL),
g AS (SELECT epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t)) AS gap FROM d),
gaps AS (SELECT gap / 1e6 AS gap_s, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1
         UNION ALL SELECT 0.0, (SELECT count({c}) - count(DISTINCT {c}) FROM {tbl})),
m AS (SELECT arg_min(gap_s, (-n, gap_s)) AS mg, sum(n) AS n_gaps FROM gaps WHERE n > 0)
"""


@query("series_frequency", GAPS_SQL.format(c="ts", tbl="events") + """
SELECT round(mg, 6) AS mode_gap_s,
  CASE WHEN n_gaps IS NULL OR n_gaps = 0 THEN 'unknown' WHEN mg / 86400 <= 1 THEN 'daily'
       WHEN mg / 86400 <= 7 THEN 'weekly' WHEN mg / 86400 <= 31 THEN 'monthly'
       WHEN mg / 86400 <= 365 THEN 'yearly' ELSE 'irregular' END AS frequency FROM m""")
def series_frequency(spark, sf):
    """G6 on event times."""
    return round_cols(G.series_frequency(t(spark, sf, "events"), "ts"))


@query("date_frequency", GAPS_SQL.format(c="o_orderdate", tbl="orders") + """
SELECT round(mg, 6) AS mode_gap_s,
  CASE WHEN (SELECT count(o_orderdate) FROM orders) < 2 THEN 'insufficient_data'
       WHEN floor(mg / 86400) = 1 THEN 'daily' WHEN floor(mg / 86400) BETWEEN 6 AND 8 THEN 'weekly'
       WHEN floor(mg / 86400) BETWEEN 28 AND 31 THEN 'monthly' WHEN floor(mg / 86400) BETWEEN 88 AND 95 THEN 'quarterly'
       WHEN floor(mg / 86400) BETWEEN 360 AND 370 THEN 'yearly' ELSE 'irregular' END AS frequency_pattern FROM m""")
def date_frequency(spark, sf):
    """G11 on order dates."""
    return round_cols(G.date_frequency(t(spark, sf, "orders"), "o_orderdate"))


@query("acf", """
WITH p AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, value - avg(value) OVER () AS d
           FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
n AS (SELECT least(20, count(*) // 4) AS lags FROM p),
l AS (SELECT unnest(range(0, (SELECT lags FROM n) + 1)) AS lag),
s AS (SELECT lag, sum(a.d * b.d) AS s FROM l, p a JOIN p b ON b.pos = a.pos + l.lag GROUP BY lag)
SELECT CAST(lag AS INTEGER) AS lag, round(s / (SELECT s FROM s WHERE lag = 0), 6) AS acf,
       abs(s / (SELECT s FROM s WHERE lag = 0)) > 0.2 AS significant FROM s""")
def acf(spark, sf):
    """Autocorrelation of the event value in (ts, event_id) order."""
    return round_cols(G.acf(t(spark, sf, "events"), "ts", "event_id", "value"))


@query("pacf", """
WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, value - avg(value) OVER () AS d
           FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
n AS (SELECT count(*) AS n, least(20, count(*) // 4) AS lags FROM p),
l AS (SELECT unnest(range(0, (SELECT lags FROM n) + 1)) AS lag),
s AS (SELECT lag, sum(a.d * b.d) / ((SELECT n FROM n) - lag) AS s FROM l, p a JOIN p b ON b.pos = a.pos + l.lag GROUP BY lag),
r AS (SELECT list(s / (SELECT s FROM s WHERE lag = 0) ORDER BY lag) AS rho FROM s),
d(k, phi) AS (
  SELECT 1, [rho[2]] FROM r
  UNION ALL
  SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - x * phi[k + 1 - i]), x) FROM (
    SELECT k, phi, (rho[k + 2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[k + 2 - i])))
                   / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[i + 1]))) AS x
    FROM d, r WHERE k < (SELECT lags FROM n)))
SELECT 0::INTEGER AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT k::INTEGER, round(phi[k], 6) FROM d""")
def pacf(spark, sf):
    """G8 (Yule-Walker on Spark-computed autocovariances)."""
    return round_cols(G.pacf(t(spark, sf, "events"), "ts", "event_id", "value"))


@query("adf_test")
def adf_test(spark, sf):
    """G9 on the event value in (ts, event_id) order (rows-only: the p-value
    surface is not expressible in SQL)."""
    return round_cols(G.adf_test(t(spark, sf, "events"), "ts", "event_id", "value"))


@query("adf_no_lags", """
WITH p AS (SELECT value AS x, lag(value) OVER (ORDER BY ts, event_id) AS l FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
f AS (SELECT regr_slope(x - l, l) AS b, regr_syy(x - l, l) * (1 - regr_r2(x - l, l)) AS ssr, regr_sxx(x - l, l) AS sxx, count(l) AS n FROM p)
SELECT 'value' AS column, round(b / sqrt(ssr / (n - 2) / sxx), 4) AS adf_statistic, 0::INTEGER AS used_lag, n AS nobs FROM f""")
def adf_no_lags(spark, sf):
    """G9 without lagged differences: the statistic in closed form."""
    r = G.adf_test(t(spark, sf, "events"), "ts", "event_id", "value", max_lag=0)
    return r.select("column", F.round("adf_statistic", 4).alias("adf_statistic"), "used_lag", "nobs")


@query("adf_two_lags", """
WITH o AS (SELECT value AS x, lag(value) OVER w AS l, value - lag(value) OVER w AS d, row_number() OVER w AS r
           FROM events WHERE ts IS NOT NULL AND value IS NOT NULL WINDOW w AS (ORDER BY ts, event_id)),
z AS (SELECT d AS y, l AS a, lag(d, 1) OVER (ORDER BY r) AS b, lag(d, 2) OVER (ORDER BY r) AS c FROM o),
f AS (SELECT y, a, b, c FROM z WHERE c IS NOT NULL),
-- The other regressors are taken out of y and of the level by Gram-Schmidt steps (each with a constant).
s1 AS (SELECT regr_slope(a, c) AS ac, regr_slope(b, c) AS bc, regr_slope(y, c) AS yc FROM f),
g AS (SELECT a - ac * c AS a, b - bc * c AS b, y - yc * c AS y FROM f, s1),
s2 AS (SELECT regr_slope(a, b) AS ab, regr_slope(y, b) AS yb FROM g),
h AS (SELECT a - ab * b AS a, y - yb * b AS y FROM g, s2),
t AS (SELECT regr_slope(y, a) AS beta, regr_syy(y, a) - regr_slope(y, a) * regr_sxy(y, a) AS ssr, regr_sxx(y, a) AS sxx, count(*) AS n FROM h)
SELECT 'value' AS column, round(beta / sqrt(ssr / (n - 4) / sxx), 4) AS adf_statistic, 2::INTEGER AS used_lag, n AS nobs FROM t""")
def adf_two_lags(spark, sf):
    """G9 with two lagged differences: the t statistic of the level."""
    r = G.adf_test(t(spark, sf, "events"), "ts", "event_id", "value", max_lag=2, search=False)
    return r.select("column", F.round("adf_statistic", 4).alias("adf_statistic"), "used_lag", "nobs")


@query("sort_by_time", "SELECT event_id, event_type FROM events")
def sort_by_time(spark, sf):
    """All events in time order."""
    return G.sort_by_time(t(spark, sf, "events"), "ts", "event_id").select("event_id", "event_type")


@query("moving_average", """
WITH daily AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
s AS (SELECT cal.day, mean FROM cal LEFT JOIN daily USING (day))
SELECT strftime(day, '%Y-%m-%d') AS day, round(mean, 6) AS mean,
  round(CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END, 6) AS moving_average
FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_average(spark, sf):
    """Centred 7-day mean of the daily event value."""
    d = G.resample_daily(t(spark, sf, "events"), "ts", "value").select("day", "mean")
    m = G.centred_moving_average(d)
    return round_cols(m.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "mean", "moving_average"))
