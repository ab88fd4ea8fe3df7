"""Source / sink queries over the driver tables' own files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.sources import readers as A
from gridscope.sources import sinks as W
from gridscope.plans.catalog import query, t


@query("source_metadata", """
SELECT 'parquet' AS source_type, count(*) AS rows, CAST(11 AS BIGINT) AS columns, CAST(NULL AS VARCHAR) AS selected_sheet
FROM lineitem""")
def source_metadata(spark, sf):
    """A5 + A10: scan a table and report its shape."""
    return A.source_metadata(A.read_parquet(spark, f"{sf}/lineitem.parquet"), "parquet")


_FORMAT_TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "events"]


@query("detect_format", "\nUNION ALL\n".join(
    f"SELECT '{n}.parquet' AS file, 'parquet' AS extension, 'parquet' AS format, 'extension' AS decided_by, count(*) AS rows FROM {n}"
    for n in _FORMAT_TABLES))
def detect_format(spark, sf):
    """A8 over the tables' files, each then read by the format found."""
    paths = ",".join(_FORMAT_TABLES)
    found = A.detect_format(spark, f"{sf}/{{{paths}}}.parquet").withColumn("file", F.element_at(F.split("path", "/"), -1))
    read = None
    for r in found.select("file", "path", "format").orderBy("file").collect():  # one row a file
        rows = A.read_detected(spark, r["path"], r["format"]).agg(F.lit(r["file"]).alias("file"), F.count(F.lit(1)).alias("rows"))
        read = rows if read is None else read.unionByName(rows)
    return found.join(F.broadcast(read), "file").select("file", "extension", "format", "decided_by", "rows")


@query("records_json", """
SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS record FROM nation""")
def records_json(spark, sf):
    """Rows as JSON records."""
    return W.records_json(t(spark, sf, "nation"))


@query("preview_rows", """
SELECT * FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview_rows(spark, sf):
    """First 10 rows in key order."""
    return W.preview(t(spark, sf, "orders"), ["o_orderkey"], 10)
