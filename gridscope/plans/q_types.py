"""Type detection and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import profile as P
from gridscope.operators import semantic as C
from gridscope.operators.timeseries import date_frequency  # noqa: F401  (used via datetime_profile)
from gridscope.plans.catalog import query, round_cols, t
from gridscope.plans.q_clean import DIRTY_SQL, dirty_events

DOC_COLS = ["text", "lang", "source"]
CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _sql_text(col, typ):
    if typ == "ts":
        return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({col} AS VARCHAR)"


def _family_sum(expr, pats):
    return " + ".join(f"count_if(regexp_matches({expr}, '(?i){p}'))" for p in pats)


def _pattern_sql(tbl, cols):
    parts = []
    for col in cols:
        for fam, pats in C.PATTERNS.items():
            parts.append(
                f"SELECT '{col}' AS column, '{fam}' AS family, CAST({_family_sum(col, pats)} AS BIGINT) AS matches, "
                f"count({col}) AS non_null, round(({_family_sum(col, pats)}) / count({col}), 6) AS score FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


@query("pattern_scores", _pattern_sql("documents", DOC_COLS))
def pattern_scores(spark, sf):
    """C1 over every document's whole text."""
    return round_cols(C.pattern_scores(t(spark, sf, "documents"), DOC_COLS))


def _semantic_sql(tbl, cols):
    fams = list(C.PATTERNS)
    cands = []
    for col in cols:
        txt = f"CAST({col} AS VARCHAR)"
        for i, (fam, pats) in enumerate(C.PATTERNS.items()):
            cands.append(
                f"SELECT '{col}' AS column, '{fam}' AS type, NULL AS subtype, ({_family_sum(txt, pats)}) / count({col}) AS conf, "
                f"{i} AS ord, {_family_sum(txt, pats)} AS m FROM {tbl}")
        d = f"TRY_CAST({txt} AS DOUBLE)"
        cands.append(
            f"SELECT '{col}', 'numeric', CASE WHEN min({d}) >= 0 AND max({d}) <= 10 THEN 'scale_0_10' "
            f"WHEN min({d}) >= 0 AND max({d}) <= 100 THEN 'scale_0_100' "
            f"WHEN count_if({d} <> floor({d})) = 0 THEN 'integer' ELSE 'float' END, "
            f"count({d}) / count(*), {len(fams)}, CASE WHEN count({d}) / count(*) > 0.8 THEN 1 ELSE 0 END FROM {tbl}")
        cands.append(
            f"SELECT '{col}', 'categorical', CASE WHEN count(DISTINCT {col}) <= 10 THEN 'low_cardinality' "
            f"WHEN count(DISTINCT {col}) <= 50 THEN 'medium_cardinality' ELSE 'high_cardinality' END, "
            f"1 - count(DISTINCT {col}) / count(*), {len(fams) + 1}, "
            f"CASE WHEN count(DISTINCT {col}) / count(*) < 0.5 THEN 1 ELSE 0 END FROM {tbl}")
    q = []
    for col in cols:
        q.append(f"SELECT '{col}' AS column, greatest(0.0, 1 - 0.5 * count_if({col} IS NULL) / count(*) "
                 f"- 0.3 * (count(*) - count(DISTINCT {col}) - CASE WHEN count_if({col} IS NULL) > 0 THEN 1 ELSE 0 END) / count(*)) AS qs FROM {tbl}")
    return f"""
WITH cand AS ({' UNION ALL '.join(cands)}),
best AS (SELECT "column", arg_min(type, (-conf, ord)) AS type, arg_min(subtype, (-conf, ord)) AS subtype,
                max(conf) AS confidence FROM cand WHERE m > 0 AND conf > 0 GROUP BY "column"),
q AS ({' UNION ALL '.join(q)})
SELECT q."column", coalesce(best.type, 'unknown') AS type, best.subtype AS subtype,
       round(coalesce(best.confidence, 0.0), 6) AS confidence, round(q.qs, 6) AS quality_score
FROM q LEFT JOIN best ON q."column" = best."column"
"""


@query("semantic_types", _semantic_sql("customer", CUST_COLS))
def semantic_types(spark, sf):
    """C2-C5 combined: best type per column of ``customer``."""
    return round_cols(C.semantic_types(t(spark, sf, "customer"), CUST_COLS).drop("distinct"))


@query("semantic_details", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct,
  (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer
    WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) AS top_values,
  round(CAST(min(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS DOUBLE), 6) AS lowest, round(CAST(max(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS DOUBLE), 6) AS highest,
  round(avg(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)), 4) AS mean FROM customer""" for c in ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def semantic_details(spark, sf):
    """Statistics and top values that the type decision rests on."""
    r = C.semantic_details(t(spark, sf, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return r.select("column", "rows", "nulls", "distinct", F.array_join(F.transform(
        "top_values", lambda s: F.concat(s["value"], F.lit("="), s["count"].cast("string"))), ";").alias("top_values"),
        F.round("statistics.min", 6).alias("lowest"), F.round("statistics.max", 6).alias("highest"), F.round("statistics.mean", 4).alias("mean"))


@query("quality_scores", DIRTY_SQL + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, "
    f"count(*) - count(DISTINCT {c}) - CASE WHEN count_if({c} IS NULL) > 0 THEN 1 ELSE 0 END AS duplicates, "
    f"round(greatest(0.0, 1 - 0.5 * count_if({c} IS NULL) / count(*) - 0.3 * (count(*) - count(DISTINCT {c}) "
    f"- CASE WHEN count_if({c} IS NULL) > 0 THEN 1 ELSE 0 END) / count(*)), 6) AS quality_score FROM dirty"
    for c in ["event_id", "event_type", "value", "value_text", "user_text", "empty_col"]))
def quality_scores(spark, sf):
    """C5 on the dirty events table (NULLs and duplicates present)."""
    cols = ["event_id", "event_type", "value", "value_text", "user_text", "empty_col"]
    return round_cols(C.quality_scores(dirty_events(spark, sf).select(*cols), cols))


def _structural_sql(tbl, cols_types):
    parts = []
    for col, typ in cols_types:
        txt = _sql_text(col, typ)
        rx = "^(" + "|".join(C.START_DATE_PATTERNS) + ")"
        d = f"TRY_CAST({txt} AS DOUBLE)"
        cleaned = f"regexp_replace({txt}, '[^0-9.,+\\-]', '', 'g')"
        ld = f"TRY_CAST(replace({cleaned}, ',', '.') AS DOUBLE)"
        num = (f"(count_if({col} IS NOT NULL AND {d} IS NULL) = 0 OR "
               f"(count_if({col} IS NOT NULL AND {ld} IS NULL AND {cleaned} <> '') = 0 AND count({ld}) > 0))")
        nn = f"count({col})"
        u = f"count(DISTINCT {txt})"
        parts.append(
            f"SELECT '{col}' AS column, CASE WHEN {nn} = 0 THEN 'empty' "
            f"WHEN count_if(regexp_matches(trim({txt}), '{rx}')) / {nn} > 0.7 THEN 'datetime' "
            f"WHEN {num} THEN 'numeric' WHEN {u} / {nn} < 0.5 AND {u} < 50 THEN 'categorical' "
            f"WHEN avg(length({txt})) > 3 THEN 'text' ELSE 'categorical' END AS type, "
            f"{nn} AS non_null, {u} AS distinct FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


ORDER_TYPES = [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"),
               ("o_orderdate", "ts"), ("o_orderpriority", "s")]


@query("structural_types", _structural_sql("orders", ORDER_TYPES))
def structural_types(spark, sf):
    """C6-C9 over ``orders``."""
    return C.structural_types(t(spark, sf, "orders"), ORDER_COLS)


@query("column_profile", "\nUNION ALL\n".join(
    f"SELECT '{col}' AS column, CAST(count_if({col} IS NULL) AS BIGINT) AS null_count, "
    f"round(count_if({col} IS NULL) / count(*) * 100, 6) AS null_pct, count(DISTINCT {_sql_text(col, typ)}) AS distinct, "
    f"round(count(DISTINCT {_sql_text(col, typ)}) / count({col}) * 100, 6) AS distinct_pct FROM orders"
    for col, typ in ORDER_TYPES))
def column_profile(spark, sf):
    """C11 without the sample list (samples are checked in the unit tests)."""
    p = P.column_profile(t(spark, sf, "orders"))
    return round_cols(p.select("column", "null_count", "null_pct", "distinct", "distinct_pct"))


NUM_PROFILE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("numeric_profile", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean,
  round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std,
  (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) b
   WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers_count,
  CASE WHEN abs(g) < 0.5 THEN 'normal' WHEN g > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution_type
FROM lineitem, (SELECT skewness({c}) AS g FROM lineitem)
GROUP BY g""" for c in NUM_PROFILE_COLS))
def numeric_profile(spark, sf):
    """C12 over lineitem."""
    return round_cols(P.numeric_profile(t(spark, sf, "lineitem"), NUM_PROFILE_COLS))


@query("categorical_profile", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, arg_min(v, (-n, v)) AS most_frequent, max(n) AS frequency_of_most, count(*) AS categories,
  CASE WHEN stddev_samp(n) < avg(n) THEN 'balanced' ELSE 'skewed' END AS category_distribution,
  (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM part
    WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) AS top_categories
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 1)""" for c in ["p_brand", "p_type", "p_name"]))
def categorical_profile(spark, sf):
    """C13 over part."""
    r = P.categorical_profile(t(spark, sf, "part"), ["p_brand", "p_type", "p_name"])
    return r.withColumn("top_categories", F.array_join(F.transform(
        "top_categories", lambda s: F.concat(s["value"], F.lit("="), s["count"].cast("string"))), ";"))


@query("datetime_profile", """
WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders),
g AS (SELECT epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t)) AS gap FROM d),
gaps AS (SELECT gap / 1e6 AS gap_s, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1
         UNION ALL SELECT 0.0, (SELECT count(*) - count(DISTINCT o_orderdate) FROM orders)),
m AS (SELECT arg_min(gap_s, (-n, gap_s)) AS mg FROM gaps WHERE n > 0)
SELECT 'o_orderdate' AS column, strftime(min(o_orderdate), '%Y-%m-%d') AS min_date,
  strftime(max(o_orderdate), '%Y-%m-%d') AS max_date,
  CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS BIGINT) AS date_range_days,
  CASE WHEN count(o_orderdate) < 2 THEN 'insufficient_data'
       WHEN floor((SELECT mg FROM m) / 86400) = 1 THEN 'daily'
       WHEN floor((SELECT mg FROM m) / 86400) BETWEEN 6 AND 8 THEN 'weekly'
       WHEN floor((SELECT mg FROM m) / 86400) BETWEEN 28 AND 31 THEN 'monthly'
       WHEN floor((SELECT mg FROM m) / 86400) BETWEEN 88 AND 95 THEN 'quarterly'
       WHEN floor((SELECT mg FROM m) / 86400) BETWEEN 360 AND 370 THEN 'yearly' ELSE 'irregular' END AS frequency_pattern
FROM orders""")
def datetime_profile(spark, sf):
    """C14 + G11 over the order dates."""
    return P.datetime_profile(t(spark, sf, "orders"), "o_orderdate")


@query("data_quality", DIRTY_SQL + """
SELECT round((cells - nulls) / cells * 100, 6) AS completeness_score, round(nulls / cells * 100, 6) AS missing_data_percentage,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
  CAST(100.0 AS DOUBLE) AS data_consistency_score,
  (SELECT array_to_string(list_filter([CASE WHEN count(event_id) < count(*) THEN 'event_id' END, CASE WHEN count(ts) < count(*) THEN 'ts' END,
     CASE WHEN count(user_id) < count(*) THEN 'user_id' END, CASE WHEN count(event_type) < count(*) THEN 'event_type' END,
     CASE WHEN count(value) < count(*) THEN 'value' END, CASE WHEN count(value_text) < count(*) THEN 'value_text' END,
     CASE WHEN count(user_text) < count(*) THEN 'user_text' END, CASE WHEN count(day_text) < count(*) THEN 'day_text' END,
     CASE WHEN count(empty_col) < count(*) THEN 'empty_col' END], lambda x: x IS NOT NULL), ',') FROM dirty) AS columns_with_nulls
FROM (SELECT count(*) * 9 AS cells,
        count_if(event_id IS NULL) + count_if(ts IS NULL) + count_if(user_id IS NULL) + count_if(event_type IS NULL)
        + count_if(value IS NULL) + count_if(value_text IS NULL) + count_if(user_text IS NULL)
        + count_if(day_text IS NULL) + count_if(empty_col IS NULL) AS nulls FROM dirty)""")
def data_quality(spark, sf):
    """C15 on the dirty events table."""
    q = P.data_quality(dirty_events(spark, sf))
    return round_cols(q.withColumn("columns_with_nulls", F.array_join("columns_with_nulls", ",")))


@query("summary_stats", """
SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, CAST(8 AS BIGINT) AS numeric_columns,
       CAST(2 AS BIGINT) AS text_columns, CAST(1 AS BIGINT) AS datetime_columns FROM lineitem""")
def summary_stats(spark, sf):
    """C16 over lineitem."""
    return P.summary_stats(t(spark, sf, "lineitem"))


@query("structure_patterns", "\nUNION ALL\n".join(f"""
SELECT * FROM (SELECT '{col}' AS column, count(DISTINCT {_sql_text(col, typ)}) AS distinct,
  UNNEST(list_filter([CASE WHEN count(DISTINCT {col}) / count(*) > 0.95 THEN 'id_like' END,
                      CASE WHEN count(DISTINCT {col}) <= 3 AND count(*) > 10 THEN 'few_values' END,
                      CASE WHEN count_if({col} IS NULL) / count(*) * 100 > 50 THEN 'high_missing' END,
                      CASE WHEN {str(any(w in col.lower() for w in P.TIME_NAME_WORDS)).upper()} THEN 'time_name' END],
                     lambda x: x IS NOT NULL)) AS pattern FROM orders)""" for col, typ in ORDER_TYPES))
def structure_patterns(spark, sf):
    """C17 over orders."""
    return P.structure_patterns(t(spark, sf, "orders"))
