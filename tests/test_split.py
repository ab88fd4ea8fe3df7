"""Files read in splits give the same rows for every size of split."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gridscope.sources import readers as A
from gridscope.sources.cells import read_cells
from gridscope.sources.split import json_items, records

SIZES = [None, 41]


@pytest.fixture()
def split_of(spark):
    def use(n):
        if n:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _save(path, data):
    with open(path, "wb") as f:
        f.write(data)


def _by_csv(text, sep):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r != []]


def _texts():
    """Quoted separators, doubled quotes, line ends in quotes, quotes inside plain fields, blank lines."""
    yield 'a,b\n"x,1","say ""hi"""\n\n"two\nlines\n\nand more",5" pipe\n,\n"",z\nlast,"open to the end\n,"'.replace(',"open to the end\n,"', ",end"), ","
    rnd = random.Random(11)
    for sep in (",", ";", "\t", "|"):
        rows = []
        for _ in range(15):
            cells = []
            for _ in range(rnd.randint(1, 4)):
                plain = "".join(rnd.choice('ab é1') for _ in range(rnd.randint(0, 6)))
                kind = rnd.random()
                if kind < 0.3:
                    plain = '"' + "".join(rnd.choice(['a', '""', sep, "\n", " "]) for _ in range(rnd.randint(0, 8))) + '"'
                elif kind < 0.4:
                    plain = "q" + plain + '"' + rnd.choice(["", "x", '"'])
                cells.append(plain)
            rows.append(sep.join(cells))
        yield sep.join(["h1", "h2"]) + "\n" + "\n".join(rows) + "\n", sep


@pytest.mark.parametrize("size", SIZES)
def test_records_equal_a_whole_parse(spark, tmpdir_fresh, split_of, size):
    split_of(size)
    texts = list(_texts())
    for i, (text, _) in enumerate(texts):
        _save(os.path.join(tmpdir_fresh, f"t {i}+%.csv"), text.encode())
    got = {}
    for r in records(spark, tmpdir_fresh).withColumn("name", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).collect():
        got.setdefault(os.path.basename(r["name"]), []).append((r["rec"], list(r["fields"])))
    for i, (text, sep) in enumerate(texts):
        rows = sorted(got[f"t {i}+%.csv"])
        assert [k for k, _ in rows] == list(range(len(rows)))
        assert [f for _, f in rows] == _by_csv(text, sep)


@pytest.mark.parametrize("size", [None, 40])
def test_cells_of_files_in_several_encodings(spark, tmpdir_fresh, split_of, size):
    split_of(size)
    _save(os.path.join(tmpdir_fresh, "u.csv"), "﻿Nome;Nota;Nota\r\nJosé;7,5;\r\n\r\nAna;9;8;extra\r\n".encode())
    _save(os.path.join(tmpdir_fresh, "L.CSV"), "Nome,Nota\nMário,3\n".encode("latin-1"))
    _save(os.path.join(tmpdir_fresh, "one.csv"), b"a;b")
    _save(os.path.join(tmpdir_fresh, "empty.csv"), b"")
    cells = read_cells(spark, tmpdir_fresh).collect()
    got = sorted((r["file"], r["pos"], r["col"], r["header"], r["value"]) for r in cells)
    got = [(f, p, c, h, v) for f, p, c, h, v in got]
    head = ["Nome", "Nota", "Nota.1", "Unnamed: 3"]
    want = [("L.CSV", 0, 0, "Nome", "Mário"), ("L.CSV", 0, 1, "Nota", "3")]
    for pos, vals in enumerate((["José", "7,5", None, None], ["Ana", "9", "8", "extra"])):
        want += [("u.csv", pos, c, head[c], v) for c, v in enumerate(vals)]
    assert got == sorted(want)


def test_long_header_line(spark, tmpdir_fresh):
    names = ["column number %d" % i for i in range(6000)]
    _save(os.path.join(tmpdir_fresh, "wide.dat"), (";".join(names) + "\n" + ";".join("1" for _ in names) + "\n").encode())
    (r,) = A.sniff(spark, os.path.join(tmpdir_fresh, "wide.dat")).collect()
    assert len(";".join(names)) > 65536 and r["sep"] == ";"


DOCS = [
    [{"x": 1, "y": "a,b]}\\\" [{"}, {"x": 2, "y": None}, {"x": 3, "z": [1, 2, {"k": "}"}]}],
    {"meta": {"data": [9, 9], "n": 2}, "data": [{"x": 1}, {"x": 2, "w": {"values": [0]}}, {"x": 3}], "values": [{"q": 1}]},
    {"values": [{"x": [1, 2]}], "tail": "]"},
    {"data": {"x": 1}, "values": [[1, 2], [3]]},
    {"x": 1, "y": "a,b", "n": {"m": [1, 2]}},
    [1, "two, three", None, [4, 5], {"six": 6}],
    {"data": [], "x": 1},
    [],
    42,
    "a, \"b\"",
    {"data": [{"only": "é,\u4e2d"}]},
]


def _items(doc):
    if isinstance(doc, list):
        return doc
    if isinstance(doc, dict):
        for k in ("data", "values"):
            if isinstance(doc.get(k), list):
                return doc[k]
    return [doc]


@pytest.mark.parametrize("size, indent", [(None, 2), (29, None), (83, 2)])
def test_json_items_equal_a_whole_parse(spark, tmpdir_fresh, split_of, size, indent):
    split_of(size)
    for i, doc in enumerate(DOCS):
        _save(os.path.join(tmpdir_fresh, f"{i:02}.json"), (" \n" * (i % 2) + json.dumps(doc, indent=indent, ensure_ascii=i % 3 == 0) + "\n").encode())
    got = {}
    for r in json_items(spark, tmpdir_fresh).collect():
        got.setdefault(os.path.basename(r["path"]), []).append((r["item"], json.loads(r["text"])))
    for i, doc in enumerate(DOCS):
        assert [v for _, v in sorted(got.get(f"{i:02}.json", []), key=lambda x: x[0])] == _items(doc), doc


def test_json_tables(spark, tmpdir_fresh, split_of):
    p = os.path.join(tmpdir_fresh, "t.json")
    doc = {"data": [{"x": i, "y": f"text, {i}"} for i in range(200)], "n": 1}
    _save(p, json.dumps(doc, indent=1).encode())
    split_of(50)
    df = A.read_json_table(spark, p)
    assert df.columns == ["x", "y"] and sorted((r["x"], r["y"]) for r in df.collect()) == [(i, f"text, {i}") for i in range(200)]
    whole = A.read_json_table(spark, p, binary=True)
    assert whole.count() == 1 and set(whole.columns) == {"data", "n"}
    _save(p, json.dumps([3, 1, 2]).encode())
    assert sorted(r["value"] for r in A.read_json_table(spark, p).collect()) == [1, 2, 3]
