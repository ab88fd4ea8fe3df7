"""Cleaning queries (B1-B17) over a dirty table derived from ``events``.

The driver tables have no NULLs or duplicates, so both engines derive the
same dirty copy: the value is NULL for errors, a text copy of the value is
'n/a' for views and clicks, signups appear twice, purchases appear once more
as a wholly empty row, and one column is always NULL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.functions import columns as FC
from gridscope.operators import clean as B
from gridscope.plans.catalog import query, round_cols, t

DIRTY_SQL = """
WITH base AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value,
         CASE WHEN event_type IN ('view', 'click') THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text,
         CAST(user_id AS VARCHAR) AS user_text,
         strftime(ts, '%Y-%m-%d') AS day_text,
         CAST(NULL AS VARCHAR) AS empty_col
  FROM events),
dirty AS (
  SELECT * FROM base
  UNION ALL SELECT * FROM base WHERE event_type = 'signup'
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'purchase')
"""


def dirty_events(spark, sf):
    e = t(spark, sf, "events")
    base = e.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("n/a"))
        .otherwise(F.col("value").cast("string")).alias("value_text"),
        F.col("user_id").cast("string").alias("user_text"),
        F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
        F.lit(None).cast("string").alias("empty_col"))
    dups = base.filter(F.col("event_type") == "signup")
    empties = e.filter(F.col("event_type") == "purchase").select(
        *[F.lit(None).cast(typ).alias(n) for n, typ in base.dtypes])
    return base.unionByName(dups).unionByName(empties)


@query("clean_log", DIRTY_SQL + """
, typed AS (
  SELECT count(*) FILTER (WHERE inferred <> 'keep') AS changed FROM (
    SELECT CASE WHEN count(TRY_CAST(v AS DOUBLE)) > 0.8 * count(*) THEN 'num'
                WHEN count_if(regexp_matches(v, '(?i)(\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}|\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}|\\d{1,2}\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))')) > 0.5 * count(v) THEN 'date'
                ELSE 'keep' END AS inferred
    FROM (SELECT UNNEST([{'c': 'event_type', 'v': event_type}, {'c': 'value_text', 'v': value_text},
                        {'c': 'user_text', 'v': user_text}, {'c': 'day_text', 'v': day_text},
                        {'c': 'event_id', 'v': CAST(event_id AS VARCHAR)}, {'c': 'user_id', 'v': CAST(user_id AS VARCHAR)},
                        {'c': 'value', 'v': CAST(value AS VARCHAR)}], recursive := true)
          FROM dirty WHERE NOT (event_id IS NULL AND ts IS NULL AND user_id IS NULL AND event_type IS NULL
                                AND value IS NULL AND value_text IS NULL AND user_text IS NULL AND day_text IS NULL))
    GROUP BY c))
SELECT * FROM (
  SELECT 1 AS step, 'remove_empty_rows' AS operation,
         (SELECT count(*) FROM dirty WHERE event_id IS NULL AND ts IS NULL AND user_id IS NULL AND event_type IS NULL
            AND value IS NULL AND value_text IS NULL AND user_text IS NULL AND day_text IS NULL) AS removed_count
  UNION ALL SELECT 2, 'remove_empty_columns', 1
  UNION ALL SELECT 4, 'detect_and_fix_types', (SELECT changed FROM typed)
  UNION ALL SELECT 5, 'handle_duplicates',
         (SELECT count(*) FROM dirty WHERE event_id IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty WHERE event_id IS NOT NULL)))
WHERE removed_count > 0""")
def clean_log(spark, sf):
    """B1 -> B2 -> B3 -> B4 -> B6 with the B7 log."""
    _, log = B.clean_table(dirty_events(spark, sf))
    return log.select("step", "operation", "removed_count")


@query("infer_types", DIRTY_SQL + """
SELECT c AS column,
  CASE WHEN count(TRY_CAST(v AS DOUBLE)) > 0.8 * count(*) THEN
         CASE WHEN count_if(TRY_CAST(v AS DOUBLE) <> floor(TRY_CAST(v AS DOUBLE))) = 0 THEN 'integer' ELSE 'float' END
       WHEN count_if(regexp_matches(v, '(?i)(\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}|\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}|\\d{1,2}\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))')) > 0.5 * count(v) THEN 'datetime'
       ELSE 'keep' END AS inferred
FROM (SELECT UNNEST([{'c': 'event_type', 'v': event_type}, {'c': 'value_text', 'v': value_text},
                    {'c': 'user_text', 'v': user_text}, {'c': 'day_text', 'v': day_text},
                    {'c': 'empty_col', 'v': empty_col}, {'c': 'event_id', 'v': CAST(event_id AS VARCHAR)},
                    {'c': 'user_id', 'v': CAST(user_id AS VARCHAR)}, {'c': 'value', 'v': CAST(value AS VARCHAR)}],
                   recursive := true) FROM dirty)
GROUP BY c""")
def infer_types(spark, sf):
    return B.infer_types(dirty_events(spark, sf))


@query("drop_empty", DIRTY_SQL + """
SELECT (SELECT count(*) FROM dirty) AS rows_before,
       (SELECT count(*) FROM dirty WHERE NOT (event_id IS NULL AND ts IS NULL AND user_id IS NULL AND event_type IS NULL
            AND value IS NULL AND value_text IS NULL AND user_text IS NULL AND day_text IS NULL AND empty_col IS NULL)) AS rows_after,
       CAST(9 AS BIGINT) AS columns_before,
       CAST((SELECT (count(event_id) > 0)::INT + (count(ts) > 0)::INT + (count(user_id) > 0)::INT + (count(event_type) > 0)::INT
               + (count(value) > 0)::INT + (count(value_text) > 0)::INT + (count(user_text) > 0)::INT
               + (count(day_text) > 0)::INT + (count(empty_col) > 0)::INT FROM dirty) AS BIGINT) AS columns_after""")
def drop_empty(spark, sf):
    """B1 + B2."""
    d = dirty_events(spark, sf)
    rows_after = B.drop_empty_rows(d)
    cols_after = B.drop_empty_columns(d)
    return (d.agg(F.count(F.lit(1)).alias("rows_before"))
            .crossJoin(rows_after.agg(F.count(F.lit(1)).alias("rows_after")))
            .select("rows_before", "rows_after", F.lit(len(d.columns)).cast("long").alias("columns_before"),
                    F.lit(len(cols_after.columns)).cast("long").alias("columns_after")))


@query("dedup_rows", DIRTY_SQL + """
SELECT event_type, count(*) AS rows FROM (SELECT DISTINCT * FROM dirty) GROUP BY event_type""")
def dedup_rows(spark, sf):
    """Rows left per event type after full-row de-duplication."""
    return B.drop_duplicates(dirty_events(spark, sf)).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("impute_mean", DIRTY_SQL + """
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM base)), 6) AS value FROM base""")
def impute_mean(spark, sf):
    """B11 on the de-duplicated part of the dirty table."""
    base = dirty_events(spark, sf).filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return round_cols(B.impute(base.select("event_id", "value"), ["value"], "mean"))


@query("label_encode", """
SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS event_type_encoded, n AS count
FROM (SELECT coalesce(event_type, 'nan') AS event_type, count(*) AS n FROM events GROUP BY 1)""")
def label_encode(spark, sf):
    """Codes by sorted text."""
    enc = B.label_encode(t(spark, sf, "events"), "event_type")
    return enc.groupBy("event_type", "event_type_encoded").agg(F.count(F.lit(1)).alias("count"))


@query("standardize", """
SELECT event_id, round((value - avg(value) OVER ()) / CASE WHEN stddev_pop(value) OVER () > 0
                                 THEN stddev_pop(value) OVER () ELSE 1 END, 6) AS value
FROM events""")
def standardize(spark, sf):
    """Population-std z scores."""
    return round_cols(B.standardize(t(spark, sf, "events"), ["value"], keep=["event_id"]))


@query("parse_percent", """
SELECT event_id, TRY_CAST(trim(replace(replace(replace(replace(s, '+', ''), '-', ''), '=', ''), ',', '.')) AS DOUBLE) AS parsed
FROM (SELECT event_id, replace(CAST(value AS VARCHAR), '.', ',') ||
        CASE event_type WHEN 'click' THEN ' +' WHEN 'view' THEN ' -' WHEN 'error' THEN '=' ELSE '' END AS s
      FROM events)""")
def parse_percent(spark, sf):
    """B8 on score text such as '75,5 +' derived from the event value."""
    e = t(spark, sf, "events")
    s = F.concat(F.regexp_replace(F.col("value").cast("string"), r"\.", ","),
                 F.when(F.col("event_type") == "click", " +").when(F.col("event_type") == "view", " -")
                 .when(F.col("event_type") == "error", "=").otherwise(""))
    return e.select("event_id", FC.parse_percent(s).alias("parsed"))


@query("loose_numeric", """
SELECT event_id, TRY_CAST(replace(regexp_replace(s, '[^0-9.,+\\-]', '', 'g'), ',', '.') AS DOUBLE) AS parsed
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'R$ ' || CAST(value AS VARCHAR)
                                  WHEN 'signup' THEN CAST(value AS VARCHAR) || ' pts'
                                  ELSE CAST(value AS VARCHAR) END AS s FROM events)""")
def loose_numeric(spark, sf):
    """B9 on decorated numbers ('R$ 12.5', '3.1 pts')."""
    e = t(spark, sf, "events")
    v = F.col("value").cast("string")
    s = (F.when(F.col("event_type") == "purchase", F.concat(F.lit("R$ "), v))
         .when(F.col("event_type") == "signup", F.concat(v, F.lit(" pts"))).otherwise(v))
    return e.select("event_id", FC.loose_numeric(s).alias("parsed"))


@query("top_category_filter", """
SELECT user_id, count(*) AS rows FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 5)
GROUP BY user_id""")
def top_category_filter(spark, sf):
    """Rows of the 5 most frequent users (broadcast semi join)."""
    kept = B.filter_top_categories(t(spark, sf, "events"), "user_id", 5)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


@query("numeric_view", """
SELECT event_id, round(value, 6) AS value, user_id,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type_encoded
FROM events""")
def numeric_view(spark, sf):
    """Numeric copy with small text columns label-encoded."""
    e = t(spark, sf, "events").select("event_id", "event_type", "value", "user_id", "props")
    nv = B.numeric_view(e)
    return round_cols(nv.select(F.col("event_id").cast("long").alias("event_id"), "value",
                                F.col("user_id").cast("long").alias("user_id"), "event_type_encoded"))


@query("filter_missing_pair", DIRTY_SQL + """
SELECT event_id, value, user_id FROM dirty WHERE value IS NOT NULL AND user_id IS NOT NULL""")
def filter_missing_pair(spark, sf):
    """B17 on the dirty events."""
    return B.filter_missing_pair(dirty_events(spark, sf), "value", "user_id").select("event_id", "value", "user_id")


@query("select_by_type", """
SELECT o_orderkey, o_custkey, round(CAST(o_totalprice AS DOUBLE), 6) AS o_totalprice FROM orders""")
def select_by_type(spark, sf):
    """The numeric columns of orders."""
    return round_cols(B.select_by_type(t(spark, sf, "orders"), "number"))


@query("standardize_headers", """
SELECT c_custkey AS "a b", c_name AS "a b_1", c_nationkey AS "Column_3", c_mktsegment AS "x" FROM customer""")
def standardize_headers(spark, sf):
    """Blanks, repeated, empty and decorated headers."""
    d = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").toDF(" a  b", "a b", "Unnamed", "__x. ")
    return B.standardize_headers(d)


@query("cast_values", DIRTY_SQL + """
SELECT event_id, user_id, TRY_CAST(user_text AS BIGINT) AS user_text, strftime(TRY_CAST(day_text AS DATE), '%Y-%m-%d') AS day_text,
  event_type, value_text FROM dirty""")
def cast_values(spark, sf):
    """The values after type inference, whole numbers as bigint and dates read."""
    d = dirty_events(spark, sf).select("event_id", "user_id", "user_text", "day_text", "event_type", "value_text")
    dec = {r["column"]: r["inferred"] for r in B.infer_types(d).collect()}
    out = B.apply_types(d, dec | {"value_text": "keep"})
    return out.withColumn("day_text", F.date_format("day_text", "yyyy-MM-dd"))
