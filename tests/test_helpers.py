"""Small operators not covered by a catalogue query."""

from pyspark.sql import functions as F

from gridscope.operators import aggregates as A
from gridscope.operators import charts as K
from gridscope.operators import clean as B
from gridscope.operators import timeseries as G
from paths import SF_SMALL


def test_select_filters(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert B.select_by_type(o, "number").columns == ["o_orderkey", "o_custkey", "o_totalprice"]
    assert B.select_by_type(o, "object").columns == ["o_orderstatus", "o_orderpriority"]
    assert B.select_by_type(o, "datetime").columns == ["o_orderdate"]
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert B.filter_missing_pair(df, "a", "b").count() == 1
    assert B.filter_not_null(df, "a").count() == 2


def test_pivots(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    m = A.crosstab_matrix(o, "o_orderstatus", "o_orderpriority")
    assert m.count() == o.select("o_orderstatus").distinct().count()
    total = sum(sum(v for k, v in r.asDict().items() if k != "o_orderstatus") for r in m.collect())
    assert total == o.count()
    pm = A.pivot_mean(o, "o_orderstatus", "o_orderpriority", "o_totalprice", ["1-URGENT", "5-LOW"])
    assert pm.columns == ["o_orderstatus", "1-URGENT", "5-LOW"]


def test_time_sort_and_charts(spark):
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    first = G.sort_by_time(e, "ts", "event_id").first()
    assert first["ts"] == e.agg(F.min("ts")).first()[0]
    pts, fit = K.scatter(e, "value", "user_id")
    assert pts.count() == e.dropna(subset=["value", "user_id"]).count() and fit.count() == 1
    tree = A.group_sizes(e, ["event_type"], with_parents=False)
    assert tree.agg(F.sum("count")).first()[0] == e.count()
    assert K.animated_scatter(e, "value", "user_id", "event_type").count() == pts.count()


def test_named_columns_are_never_cut(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = [f"c{i}" for i in range(12)]
    df = li.select(*[(F.col("l_quantity") * i + F.col("l_discount")).alias(c) for i, c in enumerate(cols)])
    assert {r["column"] for r in K.radar(df, cols).collect()} == set(cols)
    assert {r["column"] for r in K.statistical_summary(df, cols).collect()} == set(cols)
    pairs, _ = K.correlation_heatmap(df, cols)
    assert pairs.count() == 66
    assert K.radar(df).count() == 6  # the default, when none is named


def test_every_chart_type_is_reachable(spark):
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for kind, cols in {"radar": ["value", "user_id"], "treemap": ["event_type"], "sunburst": ["event_type"], "scatter_points": ["value", "user_id"],
                       "scatter3d": ["value", "user_id", "event_id"], "animated_scatter": ["value", "user_id", "event_type"],
                       "parallel_coordinates": ["value", "user_id"], "statistical_summary": ["value"],
                       "distribution_comparison": ["value", "event_type"]}.items():
        assert K.chart_data(e, kind, cols).count() > 0, kind


def test_distinct_counts_exact_and_approx(spark):
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    cols = ["p_brand", "p_type", "p_size"]
    exact = {r["column"]: r["distinct"] for r in A.distinct_counts(p, cols).collect()}
    approx = {r["column"]: r["distinct"] for r in A.distinct_counts(p, cols, approx=True).collect()}
    truth = {x: p.select(x).distinct().count() for x in cols}
    assert exact == truth
    assert all(abs(approx[x] - truth[x]) <= max(2, 0.15 * truth[x]) for x in cols)


def test_bar_values_and_line_insights(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    b = K.bar_values(o, "o_orderpriority", "o_totalprice", color="o_orderstatus", top=3)
    assert b.select("x").distinct().count() == 3
    tot = {r["x"]: r["t"] for r in b.groupBy("x").agg(F.sum("y").alias("t")).collect()}
    ref = {r["o_orderpriority"]: r["t"] for r in o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("t"))
           .orderBy(F.desc("t")).limit(3).collect()}
    assert tot.keys() == ref.keys()
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    li = K.line_insights(e, "ts", "value", "event_id").first()
    assert li["points"] == e.count() and li["trend"] in {"stable", "increasing", "decreasing"}


def test_violin_densities_integrate(spark):
    import numpy as np
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    v = K.violin(e, "value", "event_type", top=3)
    assert v.select("group").distinct().count() == 3
    for g in [r["group"] for r in v.select("group").distinct().collect()]:
        pts = sorted((r["x"], r["density"]) for r in v.filter(F.col("group") == g).collect())
        xs, ys = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        area = float(np.sum((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2))
        assert 0.85 < area < 1.05
