"""Relationship and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import outliers as O
from gridscope.operators import relations as R
from gridscope.plans.catalog import query, round_cols, t

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(LI) for b in LI[i + 1:]]


@query("pearson_pairs", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr, "
    f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM lineitem" for a, b in PAIRS))
def pearson_pairs(spark, sf):
    """F1 over lineitem's measures."""
    return round_cols(R.pearson_pairs(t(spark, sf, "lineitem"), LI))


SP = ["l_quantity", "l_extendedprice", "l_discount"]
SP_PAIRS = [(a, b) for i, a in enumerate(SP) for b in SP[i + 1:]]


@query("spearman_pairs", "WITH r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}" for x in SP) +
    " FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr, count(*) AS n FROM r" for a, b in SP_PAIRS))
def spearman_pairs(spark, sf):
    """Pearson over average ranks."""
    return round_cols(R.spearman_pairs(t(spark, sf, "lineitem"), SP))


KP = [("p_size", "p_retailprice"), ("p_partkey", "p_size"), ("p_partkey", "p_retailprice")]


@query("kendall_pairs", "\nUNION ALL\n".join(f"""
SELECT '{a}' AS var1, '{b}' AS var2,
  round(s / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau_b, n
FROM (SELECT sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) AS s FROM part x JOIN part y ON x.p_partkey < y.p_partkey),
     (SELECT count(*) AS n, count(*) * (count(*) - 1) / 2 AS n0 FROM part),
     (SELECT sum(c * (c - 1) / 2) AS tx FROM (SELECT count(*) AS c FROM part GROUP BY {a})),
     (SELECT sum(c * (c - 1) / 2) AS ty FROM (SELECT count(*) AS c FROM part GROUP BY {b}))""" for a, b in KP))
def kendall_pairs(spark, sf):
    """exact tau-b over the whole part table (O(n log n) per pair)."""
    return round_cols(R.kendall_pairs(t(spark, sf, "part"), pairs=KP))


DOC_NUM = ["doc_id", "n_chars", "text_len", "n_words"]
DOC_PAIRS = [(a, b) for i, a in enumerate(DOC_NUM) for b in DOC_NUM[i + 1:]]
DOC_NUM_SQL = ("(SELECT doc_id, n_chars, length(text) AS text_len, len(string_split(text, ' ')) AS n_words "
               "FROM documents)")


def doc_numbers(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", "n_chars", F.length("text").alias("text_len"),
                    F.size(F.split("text", " ")).alias("n_words"))


@query("strong_pairs", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr, "
    f"CASE WHEN abs(corr({a}, {b})) > 0.9 THEN 'very_strong' ELSE 'strong' END AS strength, "
    f"CASE WHEN corr({a}, {b}) > 0 THEN 'positive' ELSE 'negative' END AS direction "
    f"FROM {DOC_NUM_SQL} HAVING abs(corr({a}, {b})) >= 0.7" for a, b in DOC_PAIRS) + ")")
def strong_pairs(spark, sf):
    """F4 (statistics-module labels) over F1 of document sizes."""
    p = R.strong_pairs(R.pearson_pairs(doc_numbers(spark, sf), DOC_NUM))
    return round_cols(p.select("var1", "var2", "corr", "strength", "direction"))


PC = ["l_quantity", "l_extendedprice", "l_discount"]


@query("partial_three", """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac,
                  corr(l_extendedprice, l_discount) AS bc FROM lineitem)
SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS correlation FROM r
UNION ALL SELECT 'l_quantity', 'l_discount', round((ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)), 6) FROM r
UNION ALL SELECT 'l_extendedprice', 'l_discount', round((bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)), 6) FROM r""")
def partial_three(spark, sf):
    """F5 for three columns (the closed form is the oracle)."""
    p = R.partial_correlations(t(spark, sf, "lineitem"), PC)
    return round_cols(p.select("var1", "var2", "correlation"))


def _dependency_sql(rows: str, cols: list[str]) -> str:
    """Every ordered pair of ``cols`` checked over the rows of the SELECT ``rows``."""
    return f"WITH nr AS ({rows})\nSELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS determinant, '{b}' AS dependent, 'functional_dependency' AS type, 'complete' AS strength, "
        f"count(*) AS groups, count(*) = (SELECT count({a}) FROM nr) AS is_key "
        f"FROM (SELECT {a}, count(DISTINCT {b}) AS nb FROM nr WHERE {a} IS NOT NULL GROUP BY 1) HAVING count_if(nb <> 1) = 0"
        for a in cols for b in cols if a != b) + ")"


NR_COLS = ["n_nationkey", "n_name", "n_regionkey", "r_name"]


def _nation_region(spark, sf):
    n = t(spark, sf, "nation")
    r = t(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(*NR_COLS)


@query("functional_deps", _dependency_sql(
    "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", NR_COLS))
def functional_deps(spark, sf):
    """F6 over nation joined with region."""
    return R.functional_dependencies(_nation_region(spark, sf), NR_COLS)


SALES_COLS = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "c_name", "c_nationkey", "c_mktsegment", "l_linenumber"]


@query("functional_deps_sales", _dependency_sql(
    f"SELECT {', '.join(SALES_COLS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    SALES_COLS))
def functional_deps_sales(spark, sf):
    """F6 over all line items with their orders and customers."""
    li, o, cu = t(spark, sf, "lineitem"), t(spark, sf, "orders"), t(spark, sf, "customer")
    sales = li.join(o, li.l_orderkey == o.o_orderkey).join(cu, o.o_custkey == cu.c_custkey).select(*SALES_COLS)
    return R.functional_dependencies(sales, SALES_COLS)


@query("functional_deps_orders", _dependency_sql("SELECT * FROM orders", [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def functional_deps_orders(spark, sf):
    """F6 over all orders: a key and what it determines."""
    return R.functional_dependencies(t(spark, sf, "orders"))


TWIN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("similar_twins", "\nUNION ALL\n".join(
    f"SELECT ['{x}', '{x}_twin']::VARCHAR AS columns, 2 AS size FROM lineitem HAVING count(*) > 1" for x in TWIN_COLS))
def similar_twins(spark, sf):
    """four measures of all line items and a rescaled twin of each: with as many
    clusters as measures, each cluster is a column and its twin."""
    li = t(spark, sf, "lineitem").select(*TWIN_COLS, *[(F.col(x) * 3.0 + 1.0).alias(f"{x}_twin") for x in TWIN_COLS])
    groups = R.similar_columns(li, [x + y for x in TWIN_COLS for y in ("", "_twin")])
    return groups.select(F.concat(F.lit("["), F.array_join(F.array_sort("columns"), ", "), F.lit("]")).alias("columns"), "size")


@query("scatter_fit", """
SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
  round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  abs(corr(l_quantity, l_extendedprice)) > 0.3 AS show_line,
  CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.8 THEN 'muito forte'
       WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.6 THEN 'forte'
       WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.4 THEN 'moderada'
       WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.2 THEN 'fraca' ELSE 'muito fraca' END AS strength
FROM lineitem""")
def scatter_fit(spark, sf):
    """F8: fit line of extended price on quantity."""
    return round_cols(R.scatter_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"),
                      {"correlation": 6, "slope": 6, "intercept": 4})


@query("strongest_pair", "WITH p AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS corr FROM lineitem" for a, b in PAIRS) + """)
SELECT arg_max(var1, corr) AS pos_var1, arg_max(var2, corr) AS pos_var2, round(max(corr), 6) AS pos_corr,
       arg_min(var1, corr) AS neg_var1, arg_min(var2, corr) AS neg_var2, round(min(corr), 6) AS neg_corr
FROM p WHERE corr <> 1.0""")
def strongest_pair(spark, sf):
    """F9 over F1."""
    return round_cols(R.strongest_pair(R.pearson_pairs(t(spark, sf, "lineitem"), LI)))


@query("similar_columns")
def similar_columns(spark, sf):
    """column groups from the correlation profile (rows-only check)."""
    return R.similar_columns(t(spark, sf, "lineitem"), LI + ["l_linenumber", "l_orderkey"])


OUT_COLS = [("events", "value"), ("lineitem", "l_extendedprice")]


def _listed(r):
    """Example values as text with six decimals, in their order."""
    return round_cols(r.withColumn("outlier_values", F.array_join(
        F.transform(F.coalesce("outlier_values", F.array().cast("array<double>")), lambda v: v.cast("decimal(20,6)").cast("string")), ",")))


def _examples_sql(flag, dist, tables, k=10):
    return (f"(SELECT coalesce(string_agg(CAST(CAST(value AS DECIMAL(20,6)) AS VARCHAR), ',' ORDER BY d DESC, value), '') FROM "
            f"(SELECT value, {dist} AS d FROM events, {tables} WHERE value IS NOT NULL AND {flag} ORDER BY d DESC, value LIMIT {k})) AS outlier_values")


_IQR = """(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
                     quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi
              FROM events)"""


@query("iqr_outliers", f"""
SELECT 'value' AS column, count(*) FILTER (WHERE value < lo OR value > hi) AS outlier_count,
  round(count(*) FILTER (WHERE value < lo OR value > hi) / count(*) * 100, 6) AS outlier_percentage,
  round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
  {_examples_sql("(value < lo OR value > hi)", "greatest(lo - value, value - hi)", _IQR)}
FROM events, {_IQR} WHERE value IS NOT NULL""")
def iqr_outliers(spark, sf):
    """F20 on the event value, with the ten farthest values."""
    return _listed(O.iqr_outliers(t(spark, sf, "events"), ["value"]))


_MEAN = "(SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"


@query("z_outliers", f"""
SELECT 'value' AS column, count(*) FILTER (WHERE abs(value - m) / s > 3) AS outlier_count,
  round(count(*) FILTER (WHERE abs(value - m) / s > 3) / count(*) * 100, 6) AS outlier_percentage, CAST(3.0 AS DOUBLE) AS threshold,
  {_examples_sql("abs(value - m) / s > 3", "abs(value - m) / s", _MEAN)}
FROM events, {_MEAN} WHERE value IS NOT NULL""")
def z_outliers(spark, sf):
    """F21, with the ten farthest values."""
    return _listed(O.zscore_outliers(t(spark, sf, "events"), ["value"]))


@query("modified_z_outliers", f"""
WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events),
d AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events, m)
SELECT 'value' AS column,
  count(*) FILTER (WHERE mad <> 0 AND 0.6745 * abs(value - med) / mad > 3.5) AS outlier_count,
  round(count(*) FILTER (WHERE mad <> 0 AND 0.6745 * abs(value - med) / mad > 3.5) / count(*) * 100, 6) AS outlier_percentage,
  CAST(3.5 AS DOUBLE) AS threshold,
  {_examples_sql("mad <> 0 AND 0.6745 * abs(value - med) / mad > 3.5", "0.6745 * abs(value - med) / mad", "m, d")}
FROM events, m, d WHERE value IS NOT NULL""")
def modified_z_outliers(spark, sf):
    """F22, with the ten farthest values."""
    return _listed(O.modified_z_outliers(t(spark, sf, "events"), ["value"]))


@query("upper_share", """
SELECT 'value' AS column, round(hi, 6) AS upper_bound, count(*) AS n, count(*) FILTER (WHERE value > hi) AS above,
  round(count(*) FILTER (WHERE value > hi) / count(*) * 100, 6) AS percentage,
  count(*) FILTER (WHERE value > hi) / count(*) * 100 > 5 AS flag
FROM events, (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi
              FROM events) WHERE value IS NOT NULL GROUP BY hi""")
def upper_share(spark, sf):
    """F24."""
    return round_cols(O.upper_outlier_share(t(spark, sf, "events"), ["value"]))


@query("isolation_share")
def isolation_share(spark, sf):
    """isolation forest flags (about 10 % by construction; rows-only), with
    the ten most isolated values."""
    return _listed(O.isolation_forest(t(spark, sf, "events"), ["value"], k_examples=10))


@query("isolation_bounds", """
SELECT 'value' AS column, TRUE AS at_most_a_tenth, TRUE AS same_forest_again, 10 AS examples FROM events HAVING count(value) >= 10""")
def isolation_bounds(spark, sf):
    """what holds for every forest: at most a tenth is flagged, and another
    partitioning of the table gives the same flags."""
    e = t(spark, sf, "events").select("value")
    a, b = (O.isolation_forest(x, ["value"], k_examples=10, n_trees=20) for x in (e, e.repartition(7)))
    again = b.select("column", F.col("outlier_count").alias("_n"), F.col("outlier_values").alias("_v"))
    return a.join(again, "column").select(
        "column", (F.col("outlier_percentage") <= 10.0).alias("at_most_a_tenth"),
        ((F.col("outlier_count") == F.col("_n")) & (F.col("outlier_values") == F.col("_v"))).alias("same_forest_again"),
        F.size("outlier_values").alias("examples"))
