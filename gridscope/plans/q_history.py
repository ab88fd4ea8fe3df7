"""History queries (M1-M5) over the event log read as an analysis history:
event -> analysis, event type -> file type, user -> session, value ->
processing time."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.functions.columns import utc_day, utc_timestamp
from gridscope.operators import history as M
from gridscope.plans.catalog import query, round_cols, t

ANALYSES_SQL = """
WITH analyses AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, 'upload_' || event_id AS filename,
                         event_type AS file_type, ts AS upload_timestamp, props AS analysis_data FROM events),
metrics AS (SELECT event_id AS id, event_id AS analysis_id, value AS processing_time, user_id AS data_rows,
                   CAST(length(event_type) AS BIGINT) AS charts_generated FROM events)
"""


def analyses(spark, sf):
    e = t(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"),
                    F.concat(F.lit("upload_"), F.col("event_id")).alias("filename"),
                    F.col("event_type").alias("file_type"), utc_timestamp(e, "ts").alias("upload_timestamp"),
                    F.col("props").alias("analysis_data"), F.lit("[]").alias("insights"),
                    F.lit("[]").alias("charts_data"), F.lit("{}").alias("statistics"))


def metrics(spark, sf):
    e = t(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_id").alias("analysis_id"),
                    F.col("value").alias("processing_time"), F.col("user_id").alias("data_rows"),
                    F.lit(6).cast("long").alias("data_columns"), F.length("event_type").cast("long").alias("charts_generated"),
                    F.lit(0).cast("long").alias("insights_generated"), utc_timestamp(e, "ts").alias("timestamp"))


@query("history_totals", ANALYSES_SQL + """
SELECT (SELECT count(*) FROM analyses) AS total_analyses,
  (SELECT count(*) FROM analyses WHERE CAST(upload_timestamp AS DATE) = (SELECT max(CAST(upload_timestamp AS DATE)) FROM analyses)) AS analyses_today,
  round_even(coalesce(avg(processing_time), 0), 2) AS avg_processing_time,
  CAST(trunc(coalesce(avg(data_rows), 0)) AS BIGINT) AS avg_data_rows,
  CAST(trunc(coalesce(avg(charts_generated), 0)) AS BIGINT) AS avg_charts_generated FROM metrics""")
def history_totals(spark, sf):
    """M1 with 'today' = the last day in the log (deterministic)."""
    a = analyses(spark, sf)
    last = a.agg(F.max(utc_day(F.unix_micros("upload_timestamp")))).first()[0]
    return round_cols(M.history_totals(a, metrics(spark, sf), today=last), 2)


@query("popular_types", ANALYSES_SQL + """
SELECT file_type, count(*) AS count FROM analyses GROUP BY 1 ORDER BY count DESC, file_type LIMIT 5""")
def popular_types(spark, sf):
    """M2."""
    return M.popular_file_types(analyses(spark, sf))


@query("recent_n", ANALYSES_SQL + """
SELECT id, session_id, filename, file_type, CAST(epoch_us(upload_timestamp) AS BIGINT) AS upload_us
FROM analyses ORDER BY upload_timestamp DESC, id DESC LIMIT 10""")
def recent_n(spark, sf):
    """M3: newest 10."""
    r = M.recent_analyses(analyses(spark, sf), 10)
    return r.select("id", "session_id", "filename", "file_type", F.unix_micros("upload_timestamp").alias("upload_us"))


@query("analysis_by_id", ANALYSES_SQL + """
SELECT id, session_id, file_type, json_extract_string(analysis_data, '$.k') AS k FROM analyses WHERE id = 42""")
def analysis_by_id(spark, sf):
    """M4: lookup with the JSON blob decoded."""
    r = M.analysis_by_id(analyses(spark, sf), 42)
    return r.select("id", "session_id", "file_type", F.col("analysis_data")["k"].alias("k"))


@query("latest_config", """
SELECT event_type AS key, arg_max(CAST(value AS VARCHAR), (ts, CAST(value AS VARCHAR))) AS value,
       CAST(epoch_us(max(ts)) AS BIGINT) AS updated_us FROM events GROUP BY 1""")
def latest_config(spark, sf):
    """M5: the event log read as configuration writes; the latest value per key."""
    e = t(spark, sf, "events")
    cfg = e.select(F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"),
                   utc_timestamp(e, "ts").alias("updated_at"))
    r = M.latest_config(cfg)
    return r.select("key", "value", F.unix_micros("updated_at").alias("updated_us"))
