"""Spreadsheet files as a long cell table.

Uploaded sheets are numerous and differently shaped, and their meaning
depends on row position, which a DataFrame does not keep.  Files become rows
``(file, sheet, pos, col, header, value)``: delimited ones of any size by Spark's text
scan in splits (``split``), workbooks by one task each (stdlib ``zipfile`` + XML).  Every later step
is a group-by or window partitioned by (file, sheet), so thousands of sheets of
any shape go through one job.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from functools import reduce
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.session import materialize
from gridscope.sources.split import SEPARATORS, records  # noqa: F401 - SEPARATORS is part of this module's interface

CELL_SCHEMA = "file string, sheet string, sheet_index int, pos int, col int, header string, value string"

# The order in which encodings are tried
ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1"]

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def pandas_headers(raw: list[str]) -> list[str]:
    """Header names as pandas builds them: empty -> 'Unnamed: i', repeated
    names get '.1', '.2' ..."""
    out, seen = [], {}
    for i, h in enumerate(raw):
        h = (h or "").strip() if h is not None else ""
        name = h if h != "" else f"Unnamed: {i}"
        if name in seen:
            k = seen[name]
            cand = f"{name}.{k}"
            while cand in seen:
                k += 1
                cand = f"{name}.{k}"
            seen[name] = k + 1
            seen[cand] = 1
            name = cand
        else:
            seen[name] = 1
        out.append(name)
    return out


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """All sheets of a workbook as (name, rows of text) in workbook order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            rels[r.get("Id")] = r.get("Target")
    out = []
    for i, sh in enumerate(wb.find("m:sheets", _NS)):
        target = rels.get(sh.get(_REL), f"worksheets/sheet{i + 1}.xml")
        path = target.lstrip("/") if target.startswith("/") else "xl/" + target
        root = ET.fromstring(z.read(path))
        grid: dict[int, dict[int, str]] = {}
        for row in root.iter(f"{{{_NS['m']}}}row"):
            r_idx = int(row.get("r")) - 1
            for cell in row.findall("m:c", _NS):
                ref = cell.get("r")
                typ = cell.get("t")
                v = cell.find("m:v", _NS)
                if typ == "s" and v is not None:
                    val = shared[int(v.text)]
                elif typ == "inlineStr":
                    val = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                else:
                    val = v.text if v is not None else None
                grid.setdefault(r_idx, {})[_col_index(ref)] = val
        if grid:
            n_rows = max(grid) + 1
            n_cols = max(max(r) for r in grid.values()) + 1
            rows = [[grid.get(r, {}).get(cc) for cc in range(n_cols)] for r in range(n_rows)]
        else:
            rows = []
        out.append((sh.get("name"), rows))
    return out


def rows_to_cells(file: str, sheet: str, sheet_index: int, rows: list[list]) -> list[tuple]:
    """First row = header; every later cell (empty ones as NULL) becomes a row."""
    if not rows:
        return []
    width = max(len(r) for r in rows)
    header = pandas_headers([(rows[0][i] if i < len(rows[0]) else "") or "" for i in range(width)])
    out = []
    for pos, r in enumerate(rows[1:]):
        for ci in range(width):
            v = r[ci] if ci < len(r) else None
            v = None if v is None or str(v) == "" else str(v)
            out.append((file, sheet, sheet_index, pos, ci, header[ci], v))
    return out


def _parse_workbooks(it):
    cols = ["file", "sheet", "sheet_index", "pos", "col", "header", "value"]
    for pdf in it:
        recs = []
        for path, content in zip(pdf["path"], pdf["content"]):
            for si, (sheet, rows) in enumerate(xlsx_sheets(bytes(content))):
                recs.extend(rows_to_cells(os.path.basename(path), sheet, si, rows))
        yield pd.DataFrame(recs, columns=cols).astype({"sheet_index": "int32", "pos": "int32", "col": "int32"})


def _name_columns(it):
    """One row per file: the header's fields, filled up to the file's widest row, as names."""
    for pdf in it:
        names = [pandas_headers([*raw, *[""] * (width - len(raw))]) for raw, width in zip(pdf["raw"], pdf["width"], strict=True)]
        yield pd.DataFrame({"path": pdf["path"], "names": names})


def _glob(extension: str) -> str:
    return "*." + "".join(f"[{x.lower()}{x.upper()}]" for x in extension)


def delimited_cells(spark: SparkSession, path: str, extension: str = "csv") -> DataFrame:
    """Cells of delimited files of any size: rows come from Spark's text scan with their
    places (``split.records``), and a file's header, one row, names the columns."""
    rows = materialize(records(spark, path, _glob(extension)), "records")
    about = rows.groupBy("path").agg(F.max(F.size("fields")).alias("width"), F.min_by("fields", "rec").alias("raw"))
    heads = materialize(about.select("path", "width", "raw").mapInPandas(_name_columns, "path string, names array<string>"), "heads")
    body = rows.filter("rec > 0").join(heads, "path")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    cells = body.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"), (F.col("rec") - 1).cast("int").alias("pos"), "fields", F.posexplode("names").alias("col", "header"))
    value = F.get("fields", F.col("col"))
    return cells.select("file", F.col("file").alias("sheet"), F.lit(0).alias("sheet_index"), "pos", "col", "header",
                        F.when(value != "", value).alias("value"))


def read_cells(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("csv", "xlsx")) -> DataFrame:
    """Cell table of every allowed file under ``path`` (a file, folder or glob).
    Delimited files are read in splits, whatever their size; a workbook, which is
    a compressed archive, is parsed by one task."""
    out = [delimited_cells(spark, path, x) for x in extensions if x != "xlsx"]
    if "xlsx" in extensions:
        books = spark.read.format("binaryFile").option("pathGlobFilter", _glob("xlsx")).load(path)
        out.append(books.select("path", "content").mapInPandas(_parse_workbooks, CELL_SCHEMA))
    return reduce(DataFrame.unionByName, out)


def choose_sheet(cells: DataFrame, by_bytes: bool = False) -> DataFrame:
    """A7 choice: from a path every non-empty sheet is read and the one with
    the most rows is kept (first on ties); from bytes the first sheet."""
    from pyspark.sql import Window
    nonempty = cells.filter(F.col("value").isNotNull()).groupBy("file", "sheet", "sheet_index").agg(
        F.max("pos").alias("_last"))
    if by_bytes:
        w = Window.partitionBy("file").orderBy("sheet_index")
    else:
        w = Window.partitionBy("file").orderBy(F.desc("_last"), "sheet_index")  # over the sheets of one file
    pick = nonempty.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("file", "sheet")
    return cells.join(pick, ["file", "sheet"], "left_semi")


def cells_to_table(cells: DataFrame, file: str, sheet: str | None = None) -> DataFrame:
    """One sheet back to a wide all-text table (headers as column names).
    Only for a single, already-chosen sheet: the pivot values are its headers."""
    sub = cells.filter(F.col("file") == file)
    if sheet is not None:
        sub = sub.filter(F.col("sheet") == sheet)
    heads = [r["header"] for r in sub.select("col", "header").distinct().orderBy("col").collect()]
    return sub.groupBy("pos").pivot("header", heads).agg(F.first("value")).orderBy("pos").drop("pos")


def table_to_cells(df: DataFrame, file_col: str, order: list[str], cols: list[str]) -> DataFrame:
    """A typed table as a cell table: one sheet per value of ``file_col``,
    rows numbered in ``order`` inside each sheet (range-bucketed positions),
    every value as text under its column name."""
    from gridscope.operators.order import dense_position
    pos = dense_position(df.select(F.col(file_col).alias("file"), *[F.col(f"`{o}`") for o in order],
                                   *[F.col(f"`{c}`") for c in cols if c not in order]), order, by=["file"], out="pos")
    arr = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(c).alias("header"),
                             F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)])
    return pos.select("file", F.col("file").alias("sheet"), F.lit(0).alias("sheet_index"),
                      F.col("pos").cast("int").alias("pos"), F.inline(arr))
