"""Chart-dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import charts as K
from gridscope.operators import scores as S
from gridscope.operators.aggregates import group_sizes
from gridscope.plans.catalog import query, round_cols, t


@query("histogram_bins", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi, least(50, greatest(10, CAST(floor(sqrt(count(value))) AS INTEGER))) AS bins
           FROM events WHERE value IS NOT NULL),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * bins), bins - 1) END AS INTEGER) AS bin,
             lo, hi, bins FROM events, r WHERE value IS NOT NULL)
SELECT bin, round(lo + (hi - lo) / bins * bin, 6) AS lower, round(lo + (hi - lo) / bins * (bin + 1), 6) AS upper,
       count(*) AS count FROM b GROUP BY bin, lo, hi, bins""")
def histogram_bins(spark, sf):
    """K1: automatic bin count clamp(sqrt(n), 10, 50)."""
    return round_cols(K.histogram(t(spark, sf, "events"), "value"))


@query("histogram_insights", """
SELECT 'value' AS column, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(skewness(value), 6) AS skewness,
  CASE WHEN abs(skewness(value)) < 0.5 THEN 'normal' ELSE 'skewed' END AS distribution_type
FROM events WHERE value IS NOT NULL""")
def histogram_insights(spark, sf):
    """K1 annotations (pandas' bias-corrected skew = DuckDB's skewness)."""
    return round_cols(K.histogram_insights(t(spark, sf, "events"), "value"))


@query("box_by_category", """
WITH cats AS (SELECT p_type AS g FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 10),
b AS (SELECT p_type AS g, p_retailprice AS x FROM part WHERE p_type IN (SELECT g FROM cats) AND p_retailprice IS NOT NULL),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM b GROUP BY g),
a AS (SELECT b.g AS "group", q1, median, q3, count(*) AS n,
        min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
        max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (WHERE NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS outliers_count
      FROM b JOIN q ON b.g = q.g GROUP BY b.g, q1, median, q3)
SELECT "group", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n, round(whisker_low, 6) AS whisker_low,
  round(whisker_high, 6) AS whisker_high, outliers_count, round(outliers_count / n * 100, 6) AS outliers_percentage,
  "group" = (SELECT arg_min("group", (-median, "group")) FROM a) AS highest_median
FROM a""")
def box_by_category(spark, sf):
    """K2 grouped by the 10 most frequent part types."""
    return round_cols(K.box_stats(t(spark, sf, "part"), "p_retailprice", by="p_type"))


@query("bar_counts", """
WITH vc AS (SELECT CAST(p_brand AS VARCHAR) AS category, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
top AS (SELECT * FROM vc ORDER BY count DESC, category LIMIT 20)
SELECT category, count, (SELECT count(DISTINCT p_brand) + max(CASE WHEN p_brand IS NULL THEN 1 ELSE 0 END) FROM part) AS total_categories,
  (SELECT CASE WHEN stddev_samp(count) < avg(count) THEN 'equilibrada' ELSE 'desbalanceada' END FROM top) AS distribution_balance
FROM top""")
def bar_counts(spark, sf):
    """K5 over part brands."""
    return K.bar(t(spark, sf, "part"), "p_brand")


@query("pie_with_rest", """
WITH vc AS (SELECT CAST(p_brand AS VARCHAR) AS category, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, category) AS rk FROM vc),
s AS (SELECT category, count, rk FROM r WHERE rk <= 10
      UNION ALL SELECT 'Outros', CAST(sum(count) AS BIGINT), 11 FROM r WHERE rk > 10 HAVING sum(count) > 0)
SELECT category, count, round(count / (SELECT sum(count) FROM s) * 100, 6) AS percentage, rk = 1 AS largest FROM s""")
def pie_with_rest(spark, sf):
    """K6 over part brands."""
    return round_cols(K.pie(t(spark, sf, "part"), "p_brand"))


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_heatmap", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 2) AS corr FROM lineitem"
    for i, a in enumerate(LI) for b in LI[i + 1:]))
def correlation_heatmap(spark, sf):
    """K8: correlations rounded to 2 decimals."""
    pairs, _ = K.correlation_heatmap(t(spark, sf, "lineitem"), LI)
    return pairs.select("var1", "var2", "corr")


@query("radar_means", "WITH m AS (" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS column, avg({x}) AS mean FROM lineitem" for x in LI) + """)
SELECT "column", round(mean, 6) AS mean,
  round((mean - (SELECT min(mean) FROM m)) / ((SELECT max(mean) FROM m) - (SELECT min(mean) FROM m)), 6) AS normalized FROM m""")
def radar_means(spark, sf):
    """K11."""
    return round_cols(K.radar(t(spark, sf, "lineitem"), LI))


@query("treemap_counts", """
SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1""")
def treemap_counts(spark, sf):
    """Counts by the first column."""
    return group_sizes(t(spark, sf, "customer"), ["c_mktsegment"], with_parents=False)


@query("sunburst_counts", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count,
  CAST(2 - grouping(o_orderstatus) - grouping(o_orderpriority) AS INTEGER) AS level
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def sunburst_counts(spark, sf):
    """Hierarchy counts with every parent level."""
    return group_sizes(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("statistical_summary", "\nUNION ALL\n".join(
    f"""SELECT '{x}' AS column, UNNEST(['count', 'mean', 'std', 'min', 'p25', 'p50', 'p75', 'max']) AS statistic,
  round(UNNEST([CAST(count({x}) AS DOUBLE), avg({x}), stddev_samp({x}), min({x}), quantile_cont({x}, 0.25),
         quantile_cont({x}, 0.5), quantile_cont({x}, 0.75), max({x})]), 6) AS value FROM lineitem""" for x in LI))
def statistical_summary(spark, sf):
    """describe() transposed."""
    return round_cols(K.statistical_summary(t(spark, sf, "lineitem"), LI))


@query("distribution_comparison", """
WITH cats AS (SELECT event_type AS g FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 5),
b AS (SELECT event_type AS g, value AS x FROM events WHERE event_type IN (SELECT g FROM cats) AND value IS NOT NULL),
r AS (SELECT g, min(x) AS lo, max(x) AS hi FROM b GROUP BY g),
k AS (SELECT b.g, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin, lo, hi
      FROM b JOIN r ON b.g = r.g)
SELECT g AS "group", bin, round(lo + (hi - lo) / 20 * bin, 6) AS lower, round(lo + (hi - lo) / 20 * (bin + 1), 6) AS upper,
  count(*) AS count FROM k GROUP BY g, bin, lo, hi""")
def distribution_comparison(spark, sf):
    """20-bin histograms of the event value for the 5 most frequent types."""
    return round_cols(K.distribution_comparison(t(spark, sf, "events"), "value", "event_type"))


@query("line_chart", """
SELECT epoch_us(ts) AS x_us, round(value, 6) AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL""")
def line_chart(spark, sf):
    """K4: every point of the event value over time."""
    pts = K.line_points(t(spark, sf, "events"), "ts", "value")
    return round_cols(pts.select(F.unix_micros("x").alias("x_us"), "y"))


@query("line_buckets", """
WITH pts AS (SELECT ts, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
r AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM pts),
b AS (SELECT CAST(least(floor((epoch_us(ts) - lo) / ((hi - lo) / 1000)), 999) AS BIGINT) AS bk, value, lo, hi FROM pts, r)
SELECT CAST(floor(lo + bk * ((hi - lo) / 1000)) AS BIGINT) AS x_us, round(avg(value), 6) AS y, count(*) AS n
FROM b GROUP BY bk, lo, hi""")
def line_buckets(spark, sf):
    """K4: the event value over time in 1000 time buckets."""
    pts = K.line_buckets(t(spark, sf, "events"), "ts", "value", 1000)
    return round_cols(pts.select(F.unix_micros("x").alias("x_us"), "y", "n"))


@query("density_curve", """
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM v),
b AS (SELECT least(floor((x - lo) / ((hi - lo) / 4096)), 4095) AS b, count(*) AS cnt FROM v, s GROUP BY 1),
c AS (SELECT lo + (b + 0.5) * ((hi - lo) / 4096) AS centre, cnt FROM b, s),
g AS (SELECT lo + i * ((hi - lo) / 499) AS gx FROM s, range(500) t(i))
SELECT round(gx, 6) AS x,
  round(sum(cnt * exp(-0.5 * power((gx - centre) / (sd * power(n, -0.2)), 2)) / (sd * power(n, -0.2) * sqrt(2 * pi())))
        / any_value(n), 6) AS density
FROM g, c, s GROUP BY gx""")
def density_curve(spark, sf):
    """K9: binned Gaussian kernel density of the event value on a 500-point grid."""
    return round_cols(K.density(t(spark, sf, "events"), "value"))


@query("parallel_coordinates", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({x} - (SELECT min({x}) FROM lineitem)) / (SELECT max({x}) - min({x}) FROM lineitem), 6) AS {x}" for x in LI) + " FROM lineitem")
def parallel_coordinates(spark, sf):
    """Every line item, its columns min-max scaled."""
    return round_cols(K.scaled_rows(t(spark, sf, "lineitem"), LI, ["l_orderkey", "l_linenumber"]))


@query("animated_scatter", """
SELECT event_type AS frame, round(CAST(value AS DOUBLE), 6) AS x, CAST(user_id AS DOUBLE) AS y FROM events
WHERE value IS NOT NULL AND user_id IS NOT NULL""")
def animated_scatter(spark, sf):
    """All points of every frame."""
    return round_cols(K.animated_scatter(t(spark, sf, "events"), "value", "user_id", "event_type"))


@query("scatter_points", """
SELECT o_orderstatus AS color, CAST(o_custkey AS DOUBLE) AS x, round(CAST(o_totalprice AS DOUBLE), 6) AS y FROM orders
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def scatter_points(spark, sf):
    """K3: all points."""
    return round_cols(K.scatter(t(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderstatus")[0])


@query("scatter_3d", """
SELECT CAST(l_quantity AS DOUBLE) AS x, round(CAST(l_extendedprice AS DOUBLE), 6) AS y, round(CAST(l_discount AS DOUBLE), 6) AS z FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL""")
def scatter_3d(spark, sf):
    """All points in three dimensions."""
    return round_cols(K.scatter3d(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"))


@query("scatter_plot", """
SELECT l_returnflag AS color, l_linenumber AS size, CAST(l_quantity AS DOUBLE) AS x, round(CAST(l_extendedprice AS DOUBLE), 6) AS y,
  round((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 6) AS correlation,
  round((SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem), 6) AS slope,
  round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem), 4) AS intercept,
  (SELECT abs(corr(l_quantity, l_extendedprice)) > 0.3 FROM lineitem) AS show_line
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def scatter_plot(spark, sf):
    """K3 as recommended: all points with colour, size and the fit."""
    data = K.chart_data(t(spark, sf, "lineitem"), "scatter_plot", ["l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber"])
    return round_cols(data, {"y": 6, "correlation": 6, "slope": 6, "intercept": 4})


@query("engagement_matrix", """
WITH m AS (SELECT c.c_mktsegment AS Escola, o_orderpriority || ' - ' || o_orderstatus AS area_metrica,
                  avg(o_totalprice) AS media FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT Escola, area_metrica, round(media, 4) AS media, (SELECT count(DISTINCT Escola) FROM m) AS n_rows,
  (SELECT count(DISTINCT area_metrica) FROM m) AS n_cols,
  (SELECT count(DISTINCT Escola) FROM m) >= 2 AND (SELECT count(DISTINCT area_metrica) FROM m) >= 2 AS shown FROM m""")
def engagement_matrix(spark, sf):
    """Mean by (segment, "priority - status")."""
    o = t(spark, sf, "orders")
    cu = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    rec = o.join(cu, o.o_custkey == cu.c_custkey).select(
        F.col("c_mktsegment").alias("Escola"), F.col("o_orderpriority").alias("Area"),
        F.col("o_orderstatus").alias("Metrica"), F.col("o_totalprice").alias("Valor"))
    return round_cols(S.engagement_matrix(rec), 4)


def _dashboard_sql():
    from gridscope.plans.catalog import ORACLES
    return ("SELECT CAST(rank - 1 AS INTEGER) AS chart_id, chart_type, columns, TRUE AS has_data FROM ("
            + ORACLES["chart_recommendations"] + ") WHERE rank <= 6")


@query("dashboard", None)
def dashboard(spark, sf):
    """The first six recommended charts of ``orders`` with their datasets
    built; a chart without a row of data would be missing."""
    from gridscope.operators import rules as J
    from gridscope.operators import semantic as C
    from gridscope.plans.q_rules import _with_ord
    from gridscope.plans.q_types import ORDER_COLS
    o = t(spark, sf, "orders")
    types = _with_ord(spark, C.semantic_types(o, ORDER_COLS), ORDER_COLS)
    recs = [(r["chart_type"], list(r["columns"])) for r in J.recommend_charts(types).orderBy("ord").collect()]
    return K.dashboard(o, recs, 6).groupBy("chart_id", "chart_type", F.array_join("columns", ",").alias("columns")).agg(
        (F.max(F.length("data")) > 2).alias("has_data"))


@query("violin_by_type", """
WITH cats AS (SELECT event_type AS g FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 10),
v AS (SELECT event_type AS g, value AS x FROM events WHERE value IS NOT NULL AND event_type IN (SELECT g FROM cats)),
s AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM v GROUP BY g
      HAVING stddev_samp(x) > 0 AND max(x) > min(x)),
s2 AS (SELECT *, sd * power(n, -0.2) AS bw, (hi - lo) / 1024 AS w FROM s),
b AS (SELECT v.g, least(floor((x - lo) / w), 1023) AS b, count(*) AS cnt FROM v JOIN s2 ON v.g = s2.g GROUP BY 1, 2),
c AS (SELECT b.g, lo + (b + 0.5) * w AS centre, cnt, bw, n FROM b JOIN s2 ON b.g = s2.g),
p AS (SELECT g, lo + i * ((hi - lo) / 199) AS px FROM s2, range(200) t(i))
SELECT p.g AS "group", round(px, 6) AS x,
  round(sum(cnt * exp(-0.5 * power((px - centre) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n), 6) AS density
FROM p JOIN c ON p.g = c.g GROUP BY p.g, px""")
def violin_by_type(spark, sf):
    """K9 by category: densities of the event value per event type."""
    return round_cols(K.violin(t(spark, sf, "events"), "value", "event_type"))
