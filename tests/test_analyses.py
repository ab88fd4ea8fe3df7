"""The analyses users call (P2-P4) end to end on driver tables."""

from gridscope.plans import analyses as P
from gridscope.session import table
from paths import SF_SMALL


def test_smart_analysis(spark):
    r = P.smart_analysis(table(spark, SF_SMALL, "orders"), statistics=False)
    assert {"cleaned", "cleaning_log", "types", "dependencies", "anomalies", "chart_recommendations",
            "insights"} <= set(r)
    types = {x["column"]: x["type"] for x in r["types"].collect()}
    assert types["o_orderpriority"] == "categorical" and types["o_orderdate"] == "date"
    deps = {(x["determinant"], x["dependent"]) for x in r["dependencies"].collect()}
    assert ("o_orderkey", "o_totalprice") in deps
    assert r["insights"].count() >= 1


def test_smart_analysis_finds_the_time_column(spark, monkeypatch):
    """The statistics step gets the order date and a tie-breaker from the rows' contents."""
    given = {}

    def record(data, nums, texts, time_col, tie):
        given.update(columns=data.columns, nums=nums, time_col=time_col, tie=tie)
        return {}

    monkeypatch.setattr(P, "comprehensive_statistics", record)
    P.smart_analysis(table(spark, SF_SMALL, "orders"))
    assert given["time_col"] == "o_orderdate" and given["tie"] in given["columns"]
    assert given["tie"] not in given["nums"] and "o_totalprice" in given["nums"]
    types = spark.createDataFrame([("x", "numeric")], "column string, type string")
    assert P._time_column(spark.createDataFrame([(1,)], "x int"), types) is None


def test_auto_structure(spark):
    r = P.auto_structure(table(spark, SF_SMALL, "lineitem"), preview_order=["l_orderkey", "l_linenumber"])
    assert r["columns"].count() == 11 and r["preview"].count() == 10
    assert r["recommendations"].filter("type = 'correlation_heatmap'").count() == 1


def test_comprehensive_statistics(spark):
    ev = table(spark, SF_SMALL, "events")
    r = P.comprehensive_statistics(ev, ["value", "user_id"], ["event_type"], time_col="ts", tie="event_id")
    assert r["acf"].count() >= 2 and r["trend"].count() == 2
    assert all(0 <= x["p_value"] <= 1 for x in r["trend"].collect())
    assert r["recommendations"].count() >= 1
    assert r["stationarity"].count() == 2 and r["durbin_watson"].count() == 2
    assert r["t_test"].count() == 2 and r["acf"].select("column").distinct().count() == 2
    assert r["cluster_labels"].count() == ev.count()


def test_export_document(spark):
    import json
    r = P.smart_analysis(table(spark, SF_SMALL, "customer"), statistics=False)
    stats = {"describe": __import__("gridscope.operators.aggregates", fromlist=["describe"]).describe(
        r["cleaned"], ["c_acctbal"]), "normality": spark.range(1), "cluster_labels": r["cleaned"]}
    doc = json.loads(P.export_document(r, stats).first()["document"])
    assert {"data_info", "cleaning_log", "column_types", "insights", "chart_recommendations", "statistics"} <= set(doc)
    assert doc["data_info"][0]["rows"] == 150
    assert "statistics_normality" in doc and "statistics_cluster_labels" not in doc
