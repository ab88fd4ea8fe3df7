"""Score tables over sheets that keep arriving.

The reference handles one complete upload at a time.  On Spark the same
operators run on a stream of rows: the row-wise steps (empty-row removal,
percent-text parsing, row means) are stateless, and the per-entity means
are a streaming aggregation whose state is (sum, count) per (sheet, entity),
checkpointed in the folder the caller gives (shared storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.columns import c, parse_percent
from gridscope.operators.aggregates import row_mean
from gridscope.operators.scores import ENTITY, MEAN, SHEET, USED


def clean_rows(stream: DataFrame, percent_cols: list[str] | None = None) -> DataFrame:
    """Drop wholly empty rows and parse percent-text columns (stateless)."""
    out = stream.dropna(how="all")
    for x in percent_cols or []:
        out = out.withColumn(x, parse_percent(c(x)))
    return out


def stream_row_scores(stream: DataFrame, entity: str, sheet: str, score_cols: list[str]) -> DataFrame:
    """L7 / D22 on a stream: one score row per entity row (stateless)."""
    base = stream.filter(c(entity).isNotNull()).select(
        c(entity).cast("string").alias(ENTITY), c(sheet).cast("string").alias(SHEET), *[c(x) for x in score_cols])
    return row_mean(base, score_cols, keep=[ENTITY, SHEET], mean_name=MEAN, count_name=USED)


def running_entity_means(scores: DataFrame, event_time: str | None = None, watermark: str = "1 day") -> DataFrame:
    """D14 / L6 as a streaming aggregation: state is (sum, count) per
    (sheet, entity); the mean is derived on output.  With ``event_time`` the means
    are per day of the event, and the watermark lets the state of past days go;
    without it the state has one row per (sheet, entity)."""
    keys = [F.col(SHEET), F.col(ENTITY)]
    if event_time:
        scores = scores.withWatermark(event_time, watermark)
        keys.append(F.window(event_time, "1 day").alias("day"))
    agg = scores.groupBy(*keys).agg(F.sum(MEAN).alias("_s"), F.count(MEAN).alias("_n"))
    day = [F.col("day.start").alias("day")] if event_time else []
    return agg.select(SHEET, ENTITY, *day, (F.col("_s") / F.col("_n")).alias(MEAN), F.col("_n").alias(USED))


def start(agg: DataFrame, checkpoint: str, sink: str = "memory", name: str = "entity_means",
          mode: str = "complete", path: str | None = None):
    """Start the query; ``checkpoint`` must be durable storage."""
    w = agg.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    elif sink == "parquet":
        w = w.format("parquet").option("path", path)
    else:
        w = w.format(sink)
    return w.start()


def watch_sheets(spark, folder: str, schema: str, entity: str, score_cols: list[str], checkpoint: str,
                 name: str = "sheet_means", trigger_once: bool = False, path: str | None = None):
    """Score sheets (same layout) as they land in ``folder``: each new CSV
    file is a sheet named by its file name; the running entity means are
    kept in the streaming state.  Returns the started query.

    With ``path`` each batch appends the means it has changed as Parquet under
    ``batch=<id>`` (a batch that runs again replaces its own files) and
    ``latest_means`` reads the present ones; without it all means are kept in
    the driver's memory table ``name``, for tries on small folders."""
    files = (spark.readStream.option("header", True).schema(schema).csv(folder)
             .withColumn("_sheet", F.col("_metadata.file_name")))
    means = running_entity_means(stream_row_scores(clean_rows(files), entity, "_sheet", score_cols))
    w = means.writeStream.outputMode("update" if path else "complete").option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if path:
        return w.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start()
    return w.format("memory").queryName(name).start()


def latest_means(spark, path: str) -> DataFrame:
    """The present mean of every sheet and entity from the batches in ``path``."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.groupBy(SHEET, ENTITY).agg(F.max_by(F.struct(MEAN, USED), "batch").alias("m"))
    return last.select(SHEET, ENTITY, "m.*")
