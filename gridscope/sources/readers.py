"""Table readers (A1-A10).

Every reader returns a DataFrame.  Only format decisions (separator,
encoding, file kind) look at a file's first bytes; the data itself is always
read by Spark's own scans or by one task per file.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.sources.cells import ENCODINGS
from gridscope.sources.split import SEPARATORS, first_lines, json_items, read_json_lines

# File extensions and the format each one means
EXTENSIONS = {
    "csv": "csv", "txt": "csv", "tsv": "csv",
    "xlsx": "excel", "xls": "excel", "xlsm": "excel",
    "json": "json", "parquet": "parquet", "feather": "feather",
    "xml": "xml",
}


# Spark's CSV reader names for the Python codecs we sniff (cp1252 has no Spark
# charset; its nearest is ISO-8859-1)
SPARK_CHARSETS = {"utf-8": "utf-8", "latin-1": "iso-8859-1", "iso-8859-1": "iso-8859-1", "cp1252": "iso-8859-1"}


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8",
              header: bool = True) -> DataFrame:
    """A1: delimited text, every column read as text (types are inferred
    afterwards with one aggregate, see clean.infer_types)."""
    encoding = SPARK_CHARSETS.get(encoding.lower(), encoding)
    df = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
          .option("multiLine", False).option("mode", "PERMISSIVE").csv(path))
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first[1:])
    return df


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """A2 decisions per file: ``(file, encoding, sep)``.  UTF-8 when every line of
    the whole file is valid, else the first of the fixed list that takes any
    byte; the separator comes from the header line, however long.  One text scan in
    splits; no file is loaded whole."""
    reader = spark.read.option("lineSep", "\n").text(path)
    lines = reader.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("id"), "value")
    files = first_lines(lines)
    header = F.regexp_replace(F.decode(F.col("head").cast("binary"), "iso-8859-1"), "\r$", "")
    sep = F.coalesce(*[F.when(F.contains(header, F.lit(x)), F.lit(x)) for x in SEPARATORS], F.lit(SEPARATORS[0]))
    fallback = next(e for e in ENCODINGS if e != "utf-8")
    found = files.select(F.col("path").alias("file"), F.when(F.col("utf8"), "utf-8").otherwise(fallback).alias("encoding"), sep.alias("sep"))
    return found


def read_csv_sniffed(spark: SparkSession, path: str, separators_only: bool = False) -> DataFrame:
    """A2: sniff encoding and separator of every file, then read with Spark's CSV
    scan, files of one kind together.  ``separators_only`` is the upload route's
    variant: UTF-8 always (bad bytes replaced), only the separator is sniffed."""
    kinds = sniff(spark, path)
    if separators_only:
        kinds = kinds.withColumn("encoding", F.lit("utf-8"))
    found = kinds.groupBy("encoding", "sep").agg(F.collect_list("file").alias("files")).orderBy("encoding", "sep").collect()
    parts = [read_csv(spark, r["files"], sep=r["sep"], encoding=r["encoding"]) for r in found]
    if not parts:
        return read_csv(spark, path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_whitespace_table(spark: SparkSession, path: str) -> DataFrame:
    """A3: the first line split on whitespace is the header; later lines are
    kept only when they have the same number of tokens.  The first line is
    found as the smallest row id, which follows file order."""
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    toks = lines.select("_id", F.split(F.trim("value"), r"\s+").alias("t")).filter(F.trim(F.col("t")[0]) != "")
    head = toks.orderBy("_id").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "value string")
    names = head[0]["t"]
    body = toks.filter((F.col("_id") != head[0]["_id"]) & (F.size("t") == len(names)))
    return body.select(*[F.col("t")[i].alias(n) for i, n in enumerate(names)])


def read_json_table(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """A4: a JSON list -> rows; an object with ``data`` or ``values`` -> rows
    of that list (the bytes variant ignores them); another object -> one
    row; a scalar, or an element that is no object -> a row with column ``value``.
    Files of any size are read in splits (``split.json_items``)."""
    return read_json_lines(json_items(spark, path, () if binary else ("data", "values")))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A5."""
    return spark.read.parquet(path)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather / Arrow IPC files, one file per task (``mapInArrow``);
    the schema comes from the first file's footer."""
    import pyarrow as pa
    import pyarrow.feather as feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.select("path").orderBy("path").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "value string")
    local = first[0]["path"].replace("file:", "", 1)
    schema_arrow = pa.ipc.open_file(local).schema if os.path.exists(local) else feather.read_table(local).schema
    schema = from_arrow_schema(schema_arrow)

    def parse(it):
        import io
        import pyarrow.feather as fe
        for batch in it:
            for content in batch.column("content").to_pylist():
                tbl = fe.read_table(io.BytesIO(content))
                for rb in tbl.to_batches():
                    yield rb

    return files.select("content").mapInArrow(parse, schema)


def detect_format(spark: SparkSession, path: str) -> DataFrame:
    """Format of every file: by extension, else by magic bytes
    (``PK`` -> excel, ``<?xml`` -> xml, ``{``/``[`` -> json, else csv).
    Files with a known extension are decided from the listing alone; only the
    others have their bytes read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("uri"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = list(EXTENSIONS)
    mapping = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    by_ext = files.select("path", ext.alias("extension")).filter(F.col("extension").isin(known)).select(
        "path", "extension", mapping[F.col("extension")].alias("format"), F.lit("extension").alias("decided_by"))
    others = [r["path"] for r in files.filter(~ext.isin(known)).select("path").collect()]  # of the listing
    if not others:
        return by_ext
    lines = spark.read.option("lineSep", "\n").text(others).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    place = F.struct("block", "id")
    heads = lines.groupBy(F.col("path").alias("uri")).agg(F.min_by("value", place).alias("first"),
                                      F.min_by("value", F.when(F.trim("value") != "", place)).alias("text"))
    head = F.ltrim(F.coalesce("text", F.lit("")))
    magic = (F.when(F.substring(F.col("first").cast("binary"), 1, 2) == F.lit(b"PK"), "excel")
             .when(head.startswith("<?xml"), "xml")
             .when(head.startswith("{") | head.startswith("["), "json").otherwise("csv"))
    listed = files.filter(~ext.isin(known)).select("path", "uri", ext.alias("extension"))
    # An empty file has no line.
    by_bytes = listed.join(heads.select("uri", magic.alias("_m")), "uri", "left").select(
        "path", "extension", F.coalesce("_m", F.lit("csv")).alias("format"), F.lit("content").alias("decided_by"))
    return by_ext.unionByName(by_bytes)


def read_detected(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One file (or folder) by the format that ``detect_format`` has found for it;
    workbooks and other formats without a table reader are an error."""
    readers = {"parquet": read_parquet, "json": read_json_table, "csv": read_csv_sniffed, "feather": read_feather}
    if fmt not in readers:
        raise ValueError(f"no table reader for format {fmt}: {path}")
    return readers[fmt](spark, path)


def read_sheets(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("xlsx", "xls", "csv")) -> DataFrame:
    """Every allowed file as a typed-as-text table in one DataFrame with
    the file name as ``Planilha`` (``unionByName`` over different shapes is
    done by the cell table instead: see sources.cells.read_cells)."""
    from gridscope.sources.cells import read_cells
    return read_cells(spark, path, extensions=tuple(a for a in allowed if a != "xls"))


def source_metadata(df: DataFrame, source_type: str, selected: str | None = None) -> DataFrame:
    """A10: one-row metadata table (rows counted by Spark)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(source_type).alias("source_type"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(selected).cast("string").alias("selected_sheet"))


def write_feather_fixture(pdf: pd.DataFrame, path: str) -> None:
    """Helper for tests: write a Feather file with pyarrow."""
    import pyarrow as pa
    import pyarrow.feather as feather
    feather.write_feather(pa.Table.from_pandas(pdf, preserve_index=False), path)


__all__ = ["ENCODINGS", "SEPARATORS", "read_csv", "read_csv_sniffed", "read_whitespace_table", "read_json_table",
           "read_parquet", "read_feather", "detect_format", "read_sheets", "source_metadata", "sniff"]
