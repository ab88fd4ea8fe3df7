"""Operator 13 against a plain list-by-list tree."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.llm import merkle as M


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf_of(row, plus=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + plus
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        up = levels[-1]
        levels.append([H(*up[i:i + 2]) for i in range(0, len(up), 2)])
    return levels


def brute(rows, tampered):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda g: b"" if g is None else b"+" + g.encode())
    for g in langs:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    levels = {g: climb([leaf_of(r) for r in trees[g]]) for g in langs}
    top = climb([levels[g][-1][0] for g in langs]) if langs else []
    out = []
    for at, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            steps = []
            for lv, k in ((levels[g], i), (top, at)):
                for nodes in lv[:-1]:
                    steps.append((k % 2, nodes[k ^ 1] if k ^ 1 < len(nodes) else None))
                    k //= 2
            cur = leaf_of(r, 1 if tampered(r[0]) else 0)
            for left, x in steps:
                cur = H(cur) if x is None else H(x, cur) if left else H(cur, x)
            out.append((r[0], leaf_of(r), levels[g][-1][0], top[-1][0], H(*[x for _, x in steps if x]), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def seventh(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def run(spark, rows, height, extra=lambda df: df):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = extra(spark.createDataFrame(rows, schema).repartition(3))
    got = sorted((tuple(r) for r in M.manifest(df, M.every_seventh(F.col("doc_id")), height).collect()), key=str)
    assert got == brute(rows, seventh)
    return got


def test_layout_is_a_bijection_with_close_subtrees():
    for levels in range(1, 13):
        at = M.addresses(levels)
        assert sorted(at) == list(range(2 ** levels - 1)) and at[0] == 0
    at = M.addresses(12)
    # Every subtree at half height lies in one stretch.
    for i in range(64):
        nodes = [2 ** (6 + d) - 1 + i * 2 ** d + k for d in range(6) for k in range(2 ** d)]
        assert np.ptp(at[nodes]) == 62


@pytest.mark.parametrize("height", [1, 3, 11])
def test_trees_of_every_shape(spark, height):
    """Languages of 1 to 70 documents: lone leaves, uneven levels, several levels of blocks."""
    rows = [(1000 * k + 13 * i % 997, f"text {i}", lang, "s", i) for k, (lang, n) in enumerate(
        {"a": 1, "b": 2, "c": 3, "d": 8, "e": 9, "f": 70, None: 17, "é": 5}.items()) for i in range(n)]
    got = run(spark, rows, height)
    assert {r[6] for r in got} == {True, False}


def test_nulls_repeats_and_long_texts(spark, with_clashes):
    rows = [(5, "x", "en", "a", 1), (5, "x", "en", "a", 1), (5, "y", "en", "a", 1), (None, None, None, None, None), (None, "", "", "", 0),
            (7, "中" * 200_000, "en", None, None), (-3, "z", "en", "-", -1), (28, "t", "+", "s", None), (9, "-", "", "-", 9)]
    add = lambda df: df.selectExpr("*", "'q' AS g", "1 AS pos", "2 AS n", "'i' AS id", "3 AS digest", "4 AS _gs_b")
    run(spark, rows, 2, lambda df: add(with_clashes(df).drop("n_words")))
    assert run(spark, [], 2) == []
    (one,) = run(spark, [(3, "only", "en", "a", 4)], 2)
    assert one[1] == one[2] == one[3] and one[4] == H("")


def test_query_equals_sql_and_finds_the_tampered(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(M.OP13_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in M.op13_merkle(spark, sf).collect()), key=str)
    assert got == want
    assert all(r[6] != seventh(r[0]) for r in got)
