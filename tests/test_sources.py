"""Readers and writers on fixtures generated in a fresh temp folder."""

import json
import os
import zipfile

import pandas as pd
import pytest

from gridscope.sources import readers as A
from gridscope.sources import sinks as W
from gridscope.sources.cells import choose_sheet, read_cells, xlsx_sheets


def _write(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc, newline="") as f:
        f.write(text)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("enc", ["utf-8", "latin-1"])
def test_sniffed_csv(spark, tmpdir_fresh, sep, enc):
    p = os.path.join(tmpdir_fresh, "t.csv")
    _write(p, sep.join(["nome", "nota", "média"]) + "\n" + sep.join(["José", "7.5", "8"]) + "\n"
           + sep.join(["Ana", "9", "6.5"]) + "\n", enc)
    assert [(r["encoding"], r["sep"]) for r in A.sniff(spark, p).collect()] == [(enc, sep)]
    df = A.read_csv_sniffed(spark, p)
    assert df.columns == ["nome", "nota", "média"]
    assert sorted(r["nome"] for r in df.collect()) == ["Ana", "José"]


def test_whitespace_table(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "t.txt")
    _write(p, "a  b   c\n1 2 3\n4 5\n7  8 9\n")
    df = A.read_whitespace_table(spark, p)
    assert df.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", "3"), ("7", "8", "9")]


@pytest.mark.parametrize("doc,expect", [
    ([{"x": 1}, {"x": 2}], 2),
    ({"data": [{"x": 1}, {"x": 2}, {"x": 3}]}, 3),
    ({"values": [{"x": 1}]}, 1),
    ({"x": 1, "y": "a"}, 1),
    (42, 1),
])
def test_json_shapes(spark, tmpdir_fresh, doc, expect):
    p = os.path.join(tmpdir_fresh, "t.json")
    _write(p, json.dumps(doc))
    assert A.read_json_table(spark, p).count() == expect


def test_parquet_and_feather(spark, tmpdir_fresh):
    pdf = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", "z"]})
    fp = os.path.join(tmpdir_fresh, "t.feather")
    A.write_feather_fixture(pdf, fp)
    df = A.read_feather(spark, fp)
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3]
    pq = os.path.join(tmpdir_fresh, "pq")
    spark.createDataFrame(pdf).write.parquet(pq)
    assert A.read_parquet(spark, pq).count() == 3
    meta = A.source_metadata(A.read_parquet(spark, pq), "parquet").first()
    assert (meta["rows"], meta["columns"]) == (3, 2)


def _xlsx(path, sheets):
    """Minimal workbook with inline strings (stdlib zipfile only)."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
            + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
                       f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
                   + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            body = []
            for r, row in enumerate(rows):
                cells = []
                for cidx, v in enumerate(row):
                    ref = chr(65 + cidx) + str(r + 1)
                    if isinstance(v, str):
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                    else:
                        cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                body.append(f'<row r="{r + 1}">' + "".join(cells) + "</row>")
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join(body)
                       + "</sheetData></worksheet>")


def test_workbook_sheet_choice(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "book.xlsx")
    _xlsx(p, [("small", [["nome", "nota"], ["A", 1]]),
              ("big", [["nome", "nota"], ["A", 1], ["B", 2], ["C", 3]]),
              ("mid", [["nome", "nota"], ["A", 1], ["B", 2]])])
    with open(p, "rb") as f:
        assert [n for n, _ in xlsx_sheets(f.read())] == ["small", "big", "mid"]
    cells = read_cells(spark, p)
    assert {r["sheet"] for r in choose_sheet(cells).collect()} == {"big"}
    assert {r["sheet"] for r in choose_sheet(cells, by_bytes=True).collect()} == {"small"}


def test_detect_format(spark, tmpdir_fresh):
    _write(os.path.join(tmpdir_fresh, "a.csv"), "x,y\n1,2\n")
    _write(os.path.join(tmpdir_fresh, "b.dat"), '[{"x": 1}]')
    _write(os.path.join(tmpdir_fresh, "c.bin"), "<?xml version='1.0'?><a/>")
    _xlsx(os.path.join(tmpdir_fresh, "d.noext"), [("s", [["a"], [1]])])
    got = {os.path.basename(r["path"]): r["format"] for r in A.detect_format(spark, tmpdir_fresh).collect()}
    assert got == {"a.csv": "csv", "b.dat": "json", "c.bin": "xml", "d.noext": "excel"}


def test_sinks(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(r["record"] for r in W.records_json(df).collect()) == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}']
    doc = W.export_analysis({"t1": df, "t2": df.limit(1)}).first()["document"]
    parsed = json.loads(doc)
    assert set(parsed) == {"t1", "t2"} and len(parsed["t1"]) == 2
    out = os.path.join(tmpdir_fresh, "json")
    W.write_records_json(df, out)
    assert spark.read.json(out).count() == 2
    assert [r["k"] for r in W.preview(df, ["k"], 1).collect()] == [1]


def test_score_sheets_reads_first_workbook_sheet(spark, tmpdir_fresh):
    from gridscope.plans import analyses as P
    p = os.path.join(tmpdir_fresh, "notas.xlsx")
    _xlsx(p, [("primeira", [["Nome da Escola", "Nota 1"], ["E1", 5], ["E2", 7]]),
              ("segunda", [["Nome da Escola", "Nota 1"], ["E9", 1], ["E8", 2], ["E7", 3]])])
    res = P.score_sheets(read_cells(spark, p))
    got = {(r["Planilha"], r["Escola"]): r["Media"] for r in res["scores"].collect()}
    assert got == {("notas.xlsx", "E1"): 5.0, ("notas.xlsx", "E2"): 7.0}


def test_encoding_is_judged_on_all_bytes_and_per_file(spark, tmpdir_fresh):
    """A two-byte character across byte 65,536, beside a file of another encoding."""
    folder = os.path.join(tmpdir_fresh, "enc")
    os.makedirs(folder)
    body = "name;x\n" + "".join(f"r{i};{i}\n" for i in range(20000))
    at = 65535 - len("name;x\n")
    head = ("name;x\n" + ("a" * (at - 1)) + "é;1\n").encode()
    assert head[65535 - 1:65537].count(b"\xc3") == 1
    with open(os.path.join(folder, "a.csv"), "wb") as f:
        f.write(head + body[7:].encode())
    with open(os.path.join(folder, "b.csv"), "wb") as f:
        f.write("name,x\ncafé,2\n".encode("latin-1"))
    got = {os.path.basename(r["file"]): (r["encoding"], r["sep"]) for r in A.sniff(spark, folder).collect()}
    assert got == {"a.csv": ("utf-8", ";"), "b.csv": ("latin-1", ",")}
    df = A.read_csv_sniffed(spark, folder)
    assert df.count() == 20002 and df.filter("name = 'café'").count() == 1 and df.filter("name LIKE '%aé'").count() == 1


def test_read_detected(spark, tmp_path):
    """Each file is read by the format found in its name or its bytes."""
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.csv").write_text("x;y\n1;2\n3;4\n5;6\n")
    (tmp_path / "plain").write_text('[{"x": 1}]')
    spark.range(4).write.parquet(str(tmp_path / "d.parquet"))
    got = {r["path"].rsplit("/", 1)[1]: A.read_detected(spark, r["path"], r["format"]).count()
           for name in ("a.json", "b.csv", "plain") for r in A.detect_format(spark, str(tmp_path / name)).collect()}
    assert got == {"a.json": 2, "b.csv": 3, "plain": 1}
    assert A.read_detected(spark, str(tmp_path / "d.parquet"), "parquet").count() == 4
    with pytest.raises(ValueError):
        A.read_detected(spark, str(tmp_path / "b.csv"), "excel")
