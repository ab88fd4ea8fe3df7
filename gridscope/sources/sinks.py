"""Writers (A20-A25).  All writes go through Spark's distributed writers to a
folder the caller names (on a cluster: shared storage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The cleaned table as JSON records (one object per line, one file
    per partition)."""
    df.write.mode(mode).json(path)


def records_json(df: DataFrame) -> DataFrame:
    """A20 as a column: each row as a JSON object string."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))


def export_analysis(results: dict[str, DataFrame]) -> DataFrame:
    """One JSON document holding every (small) result table as a list of
    records, keyed by group name.  Each input is a result table (per column /
    per chart), never row-level data."""
    parts = []
    for name, df in results.items():
        parts.append(df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("v"))
                     .select(F.lit(name).alias("k"), F.to_json("v").alias("v")))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    entry = F.concat(F.lit('"'), F.col("k"), F.lit('":'), F.col("v"))
    return allp.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}"))
                    .alias("document"))


def write_export(results: dict[str, DataFrame], path: str) -> None:
    export_analysis(results).coalesce(1).write.mode("overwrite").text(path)


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in an explicit order (Spark keeps no file
    order); a top-n sort, not a full sort."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(n)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
