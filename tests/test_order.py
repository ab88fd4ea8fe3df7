"""Order primitives: the range-bucketed path must equal a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridscope.operators import order as O
from paths import SF_MID


def _hot_frame(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    # a third of the rows share one key value (a hot key)
    k = F.when(F.col("l_quantity") < 17, F.lit(1.0)).otherwise(F.col("l_extendedprice"))
    return li.select(k.alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     "l_extendedprice", "l_returnflag")


ORDER = ["k", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def test_dense_position_bucketed_equals_window(spark):
    df = _hot_frame(spark)
    for by in ([], ["l_returnflag"]):
        p = O.dense_position(df, ORDER, by=by, n_buckets=20)
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*ORDER)
        ref = df.withColumn("rpos", F.row_number().over(w) - 1)
        j = p.join(ref, ORDER + by)
        assert j.count() == df.count()
        assert j.filter("pos != rpos").count() == 0


def test_bucketed_plan_has_no_single_partition_window(spark):
    df = _hot_frame(spark)
    p = O.dense_position(df, ORDER, n_buckets=20)
    lines = p._jdf.queryExecution().executedPlan().toString().splitlines()
    # the only single-partition step allowed is the running offset over the
    # (groups x buckets) totals table, never over the rows themselves
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "_gs_tot" in lines[i + 1], lines[i + 1]


def test_quantiles_equal_exact_percentiles(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_returnflag")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for value in ("l_extendedprice", "l_quantity"):
        want = {(r[0], p): q for r in li.groupBy("l_returnflag").agg(F.percentile(value, probs)).collect() for p, q in zip(probs, r[1])}
        for rows in (None, 120):
            got = {(r["l_returnflag"], r["p"]): r["q"] for r in O.quantiles(li, value, probs, by=["l_returnflag"], n_buckets=rows).collect()}
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_string_order_splits_a_common_prefix(spark):
    names = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("name"))
    dealt = O.deal(names, ["name"], 10)
    sizes = [r["count"] for r in dealt.groupBy("_gs_b").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1200
    assert [r["pos"] for r in O.dense_position(names, ["name"]).orderBy("name").collect()] == list(range(3000))


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0, None]], "x double")
    r = {row["x"]: row["avg_rank"] for row in O.average_ranks(df, "x").collect()}
    assert r == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}
    r2 = {row["x"]: row["avg_rank"] for row in O.average_ranks(df, "x", n_buckets=3).collect()}
    assert r2 == r


@pytest.mark.parametrize("buckets", [4, 37])
def test_lags_across_buckets(spark, buckets):
    df = spark.range(60).select(F.col("id").alias("t"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    for r in O.with_lags(df, ["t"], ["v"], 5, n_buckets=buckets).collect():
        assert r["pos"] == r["t"]
        for k in range(1, 6):
            assert r[f"v_lag{k}"] == (None if r["t"] < k else float((r["t"] - k) ** 2))


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, x int")
    got = sorted((r["g"] or "", r["x"], r["pos"]) for r in O.dense_position(df, ["x"], by=["g"]).collect())
    assert got == [("", 1, 0), ("", 3, 1), ("a", 2, 0)]


def test_mixed_small_and_large_groups(spark):
    df = _hot_frame(spark).withColumn(
        "grp", F.when(F.col("k") == 1.0, F.lit("hot")).otherwise(F.col("l_returnflag")))
    p = O.dense_position(df, ORDER, by=["grp"], n_buckets=5)
    ref = df.withColumn("rpos", F.row_number().over(Window.partitionBy("grp").orderBy(*ORDER)) - 1)
    j = p.join(ref, ORDER + ["grp"])
    assert j.count() == df.count() and j.filter("pos != rpos").count() == 0


def test_buckets_are_bounded_and_written_once(spark, monkeypatch):
    """Spark's partition setting bounds the buckets, small neighbours are merged, and
    ``deal`` writes one table."""
    written = []
    real = O.materialize
    monkeypatch.setattr(O, "materialize", lambda df, label: written.append(label) or real(df, label))
    dealt = O.deal(spark.range(200_000).withColumn("v", F.rand(1)), ["v"])
    assert len(written) == 1
    assert dealt.agg(F.max("_gs_b")).first()[0] < int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = dealt.groupBy("_gs_b").agg(F.min("v").alias("a"), F.max("v").alias("z")).orderBy("_gs_b").collect()
    assert all(x["z"] < y["a"] for x, y in zip(ranges, ranges[1:], strict=False))


def test_halos_reach_over_several_small_buckets(spark):
    df = spark.range(50).select(F.col("id").alias("t"))
    rows = O.with_halo(df, ["t"], 9, n_buckets=20).collect()
    first = {}
    for r in rows:
        if not r["halo"]:
            first[r["_gs_b"]] = min(r["pos"], first.get(r["_gs_b"], 99))
    assert len(first) > 10
    for b, at in first.items():
        assert sorted(r["pos"] for r in rows if r["halo"] and r["_gs_b"] == b) == list(range(max(0, at - 9), at))
