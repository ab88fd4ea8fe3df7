"""Descriptive-aggregate queries (D1-D19) over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import aggregates as A
from gridscope.plans.catalog import query, round_cols, t

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union_sql(cols, template):
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)


@query("describe_numeric", union_sql(LI_COLS, """
SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem"""))
def describe_numeric(spark, sf):
    return round_cols(A.describe(t(spark, sf, "lineitem"), LI_COLS))


MOMENTS_COLS = LI_COLS


@query("moments", union_sql(MOMENTS_COLS, """
SELECT '{c}' AS column, n, round(m3 / power(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis,
  round(CASE WHEN n >= 3 THEN m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) END, 6) AS skew_corrected,
  round(CASE WHEN mu <> 0 THEN sd / mu ELSE 0 END, 6) AS cv, round(rng, 6) AS range,
  round(gm, 6) AS geometric_mean, round(hm, 6) AS harmonic_mean
FROM (SELECT count(*) AS n, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, avg(power(x - mu, 4)) AS m4,
        any_value(mu) AS mu, any_value(sd) AS sd, any_value(rng) AS rng, any_value(gm) AS gm, any_value(hm) AS hm
      FROM (SELECT {c} AS x, avg({c}) OVER () AS mu, stddev_samp({c}) OVER () AS sd,
                   max({c}) OVER () - min({c}) OVER () AS rng,
                   exp(avg(CASE WHEN {c} > 0 THEN ln({c}) END) OVER ()) AS gm,
                   count(CASE WHEN {c} > 0 THEN 1 END) OVER () / sum(CASE WHEN {c} > 0 THEN 1.0 / {c} END) OVER () AS hm
            FROM lineitem WHERE {c} IS NOT NULL))"""))
def moments(spark, sf):
    return round_cols(A.moments(t(spark, sf, "lineitem"), MOMENTS_COLS))


@query("robust_spread", union_sql(LI_COLS, """
SELECT '{c}' AS column, round(q25, 6) AS q25, round(med, 6) AS median, round(q75, 6) AS q75,
  round(q75 - q25, 6) AS iqr,
  round((SELECT quantile_cont(abs({c} - med), 0.5) FROM lineitem), 6) AS mad
FROM (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q75
      FROM lineitem)"""))
def robust_spread(spark, sf):
    return round_cols(A.robust_spread(t(spark, sf, "lineitem"), LI_COLS))


MODE_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("mode_value", union_sql(MODE_COLS, """
SELECT '{c}' AS column, round(x, 6) AS mode, cnt AS mode_count FROM (
  SELECT {c} AS x, count(*) AS cnt FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1
  ORDER BY cnt DESC, x ASC LIMIT 1)"""))
def mode_value(spark, sf):
    return round_cols(A.mode(t(spark, sf, "lineitem"), MODE_COLS))


PART_CATS = ["p_brand", "p_type", "p_size", "p_name"]


@query("category_frequency", union_sql(PART_CATS, """
SELECT '{c}' AS column, count(*) AS distinct, CAST(sum(cnt) AS BIGINT) AS non_null,
  arg_min(v, (-cnt, v)) AS most_frequent, max(cnt) AS most_frequent_count,
  arg_max(v, (-cnt, v)) AS least_frequent, min(cnt) AS least_frequent_count,
  round(max(cnt) / sum(cnt), 6) AS concentration,
  round(-sum(cnt / tot * log2(cnt / tot)), 6) AS entropy
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt, sum(count(*)) OVER () AS tot
      FROM part WHERE {c} IS NOT NULL GROUP BY 1)"""))
def category_frequency(spark, sf):
    return round_cols(A.frequency_summary(t(spark, sf, "part"), PART_CATS))


@query("value_counts_top", """
SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 20""")
def value_counts_top(spark, sf):
    return A.value_counts(t(spark, sf, "lineitem"), "l_partkey", 20)


@query("crosstab_status_priority", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2""")
def crosstab_status_priority(spark, sf):
    return A.crosstab(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("group_hierarchy", """
SELECT c_mktsegment, c_nationkey, count(*) AS count,
  CAST(2 - grouping(c_mktsegment) - grouping(c_nationkey) AS INTEGER) AS level
FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def group_hierarchy(spark, sf):
    return A.group_sizes(t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("group_median", """
WITH m AS (SELECT p_type AS category, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY 1)
SELECT category, round(median, 6) AS median,
  category = (SELECT arg_min(category, (-median, category)) FROM m) AS is_highest
FROM m""")
def group_median(spark, sf):
    return round_cols(A.group_median_argmax(t(spark, sf, "part"), "p_type", "p_retailprice"))


@query("group_mean_count", """
SELECT event_type, round(avg(value), 6) AS mean, count(value) AS count FROM events GROUP BY 1""")
def group_mean_count(spark, sf):
    return round_cols(A.group_mean(t(spark, sf, "events"), ["event_type"], "value"))


@query("top_k_orders", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_k_orders(spark, sf):
    """The ten largest orders (a top-k is the feature)."""
    return A.top_k(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 10,
                   tiebreak=["o_orderkey"])
