"""Analysis history (A11, A25, M1-M5): four append-only Parquet tables in a
folder the caller names (on a cluster: shared storage).

Writes are appends (one file set per call; no update in place), so lost
executors only ever re-run an append task.  "Latest value wins" for the
configuration table replaces SQL's UPDATE.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "analyses": ("id long, session_id string, filename string, file_type string, upload_timestamp timestamp, "
                 "analysis_data string, insights string, charts_data string, statistics string"),
    "performance_metrics": ("id long, analysis_id long, processing_time double, data_rows long, data_columns long, "
                            "charts_generated long, insights_generated long, timestamp timestamp"),
    "system_logs": "id long, level string, message string, module string, timestamp timestamp",
    "system_config": "key string, value string, updated_at timestamp",
}


class HistoryStore:
    """The four history tables under ``base`` (Parquet, partitioned by day)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str) -> DataFrame:
        """A history table; a folder that does not exist is an empty table, any
        other trouble is an error."""
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        return df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def append(self, name: str, df: DataFrame) -> None:
        """Append rows (typed by the table's schema)."""
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        types = {c.split()[0]: c.split()[1] for c in SCHEMAS[name].split(", ")}
        out = df.select(*[F.col(c).cast(types[c]).alias(c) for c in cols])
        ts = "upload_timestamp" if name == "analyses" else ("updated_at" if name == "system_config" else "timestamp")
        out.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(self.path(name))

    def save_analyses(self, rows: list[dict]) -> None:
        """A25 for many analyses at once: one append (one file set) for all of
        ``rows`` (id, session_id, filename, file_type, analysis, insights, charts,
        statistics)."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        text = lambda v: json.dumps(v, default=str)
        data = [(r["id"], r["session_id"], r["filename"], r["file_type"], now, text(r["analysis"]), text(r["insights"]),
                 text(r["charts"]), text(r["statistics"])) for r in rows]
        self.append("analyses", self.spark.createDataFrame(data, SCHEMAS["analyses"]))

    def save_analysis(self, id_: int, session_id: str, filename: str, file_type: str, analysis: dict,
                      insights: list, charts: list, statistics: dict) -> None:
        self.save_analyses([{"id": id_, "session_id": session_id, "filename": filename, "file_type": file_type,
                             "analysis": analysis, "insights": insights, "charts": charts, "statistics": statistics}])

    def save_metrics(self, id_: int, analysis_id: int, processing_time: float, data_rows: int, data_columns: int,
                     charts_generated: int, insights_generated: int) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = [(id_, analysis_id, float(processing_time), data_rows, data_columns, charts_generated,
                insights_generated, now)]
        self.append("performance_metrics", self.spark.createDataFrame(row, SCHEMAS["performance_metrics"]))

    def log(self, id_: int, level: str, message: str, module: str) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.append("system_logs", self.spark.createDataFrame([(id_, level, message, module, now)], SCHEMAS["system_logs"]))

    def config_set(self, key: str, value) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        v = value if isinstance(value, str) else json.dumps(value)
        self.append("system_config", self.spark.createDataFrame([(key, v, now)], SCHEMAS["system_config"]))

    def config_get(self) -> DataFrame:
        return latest_config(self.read("system_config"))


def history_totals(analyses: DataFrame, metrics: DataFrame, today=None) -> DataFrame:
    """M1: total analyses, today's analyses (UTC day), mean processing time
    (0 when none, rounded half-even to 2 decimals), and the mean rows and mean
    charts per analysis truncated to integers."""
    from gridscope.functions.columns import utc_day
    day = F.lit(today).cast("date") if today is not None else F.current_date()
    a = analyses.agg(F.count(F.lit(1)).alias("total_analyses"),
                     F.count_if(utc_day(F.unix_micros("upload_timestamp")) == day).alias("analyses_today"))
    m = metrics.agg(F.bround(F.coalesce(F.avg("processing_time"), F.lit(0.0)), 2).alias("avg_processing_time"),
                    F.coalesce(F.avg("data_rows"), F.lit(0.0)).cast("long").alias("avg_data_rows"),
                    F.coalesce(F.avg("charts_generated"), F.lit(0.0)).cast("long").alias("avg_charts_generated"))
    return a.crossJoin(m)


def popular_file_types(analyses: DataFrame, k: int = 5) -> DataFrame:
    """M2: the ``k`` most common file types (count desc, type asc)."""
    return (analyses.groupBy("file_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "file_type").limit(k))


def recent_analyses(analyses: DataFrame, n: int = 10) -> DataFrame:
    """M3: the newest ``n`` analyses (a top-n sort)."""
    return (analyses.select("id", "session_id", "filename", "file_type", "upload_timestamp")
            .orderBy(F.desc("upload_timestamp"), F.desc("id")).limit(n))


def analysis_by_id(analyses: DataFrame, id_: int, schema: str = "map<string,string>") -> DataFrame:
    """M4: point lookup with the JSON blobs decoded."""
    a = analyses.filter(F.col("id") == id_)
    return a.select("id", "session_id", "filename", "file_type", "upload_timestamp",
                    F.from_json("analysis_data", schema).alias("analysis_data"),
                    F.from_json("statistics", schema).alias("statistics"),
                    F.from_json("insights", "array<string>").alias("insights"),
                    F.from_json("charts_data", "array<string>").alias("charts_data"))


def latest_config(config: DataFrame) -> DataFrame:
    """M5: the latest value per key (append log -> latest wins)."""
    return config.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"),
                                     F.max("updated_at").alias("updated_at"))
