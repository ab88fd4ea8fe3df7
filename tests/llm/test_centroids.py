"""Operator 11 against plain nearest-centroid rounds."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from gridscope.llm import centroids as C


def brute(rows, k, rounds, dim):
    kept = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, tuple(max(-2 ** 63, min(2 ** 63 - 1, x)) for x in v)) for i, v in kept]
    by = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in by[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(at)), key=lambda j: (far(v, at[j]), j))
    for _ in range(rounds):
        won = [near(v) for _, v in kept]
        at = [tuple(sum(col) // len(mine) for col in zip(*mine, strict=True)) if (mine := [v for (_, v), w in zip(kept, won, strict=True) if w == j]) else at[j]
              for j in range(len(at))]
    return [(i, near(v), far(v, at[near(v)])) for i, v in kept], at


def run(spark, rows, dim, k=5, rounds=3, typ="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{typ}>").repartition(3)
    got, at = C.cluster(df, k=k, rounds=rounds, dim=dim)
    if typ == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, wat = brute(rows, k, rounds, dim)
    cut = lambda x: x if x < 2 ** 63 else None
    assert [tuple(c) for c in at] == wat
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, c, cut(d)) for i, c, d in want), key=key)


def test_rounds_match_brute_force(spark):
    rng = np.random.default_rng(1)
    run(spark, [(i, [float(x) for x in rng.normal(size=6) * 0.5]) for i in range(400)], 6, k=7)


def test_ties_go_to_the_smaller_number(spark):
    """A grid of few values: many vectors are equally far from several centroids, and
    repeated rows make equal centroids."""
    rng = np.random.default_rng(2)
    run(spark, [(i % 90, [float(x) / 64 for x in rng.integers(-2, 3, size=3)]) for i in range(300)], 3, k=9, rounds=2)


def test_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0])]
    run(spark, [*bad, (None, [0.5, 0.25]), (7, [-0.5, 0.1]), (7, [-0.5, 0.1]), (8, [3.0, 3.0])], 2, k=16)
    run(spark, bad, 2)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=2) * 10.0 ** rng.integers(0, 16)]) for i in range(60)]
    run(spark, [*rows, (60, [1e300, -1e300])], 2, k=4, typ="double")


def test_inertia_and_extra_columns(spark, with_clashes):
    rows = [(i, [float(i % 4), 0.0]) for i in range(20)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).selectExpr("*", "'a' AS cluster", "1 AS v")
    got, at = C.cluster(df, k=3, dim=2)
    out = C.with_inertia(got, at).collect()
    assert len(out) == 20
    for r in out:
        assert r["cluster_inertia"] == sum(x["distance"] for x in out if x["cluster"] == r["cluster"])
        assert r["inertia"] == sum(x["distance"] for x in out)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()
    none, at = C.cluster(df.limit(0), k=3, dim=2)
    assert at == [] and C.with_inertia(none, at).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    want = sorted(con.execute(C.OP11_SQL).fetchall())
    got = sorted(tuple(r) for r in C.op11_centroids(spark, f"/root/testdata/{sf}").collect())
    assert got == want and len({r[1] for r in got}) > 1
