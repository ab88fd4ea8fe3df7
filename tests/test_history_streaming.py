"""History store and the streaming score operators."""

import os

import pytest

from pyspark.sql import functions as F

from gridscope.operators import history as M
from gridscope.operators.history import HistoryStore
from gridscope.streaming import incremental as ST


def test_history_store(spark, tmpdir_fresh):
    h = HistoryStore(spark, os.path.join(tmpdir_fresh, "hist"))
    assert h.read("analyses").count() == 0
    h.save_analysis(1, "s1", "a.csv", "csv", {"rows": 3}, [], [], {})
    h.save_analysis(2, "s1", "b.xlsx", "excel", {"rows": 5}, [], [], {})
    h.config_set("theme", "dark")
    h.config_set("theme", "light")
    h.save_metrics(1, 1, 1.25, 100, 5, 3, 2)
    h.save_metrics(2, 2, 2.75, 50, 4, 1, 0)
    h.log(1, "INFO", "ok", "test")
    a = h.read("analyses")
    assert a.count() == 2
    tot = M.history_totals(a, h.read("performance_metrics")).first()
    assert (tot["total_analyses"], tot["avg_processing_time"], tot["avg_data_rows"], tot["avg_charts_generated"]) == \
        (2, 2.0, 75, 2)
    assert h.read("system_logs").count() == 1
    assert [r["id"] for r in M.recent_analyses(a, 1).collect()] == [2]
    assert M.analysis_by_id(a, 2).first()["analysis_data"]["rows"] == "5"
    assert {r["key"]: r["value"] for r in h.config_get().collect()} == {"theme": "light"}
    assert M.popular_file_types(a).count() == 2


def test_streaming_entity_means(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in")
    rows = [("A", "s1", "75,5 +", "80"), ("B", "s1", "50", None), ("A", "s2", "10", "20"), (None, "s1", "1", "1")]
    df = spark.createDataFrame(rows, "nome string, sheet string, nota1 string, nota2 string")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    cleaned = ST.clean_rows(stream, ["nota1"])
    scores = ST.stream_row_scores(cleaned, "nome", "sheet", ["nota1", "nota2"])
    q = ST.start(ST.running_entity_means(scores), os.path.join(tmpdir_fresh, "ckpt"), name="gs_means_test")
    q.processAllAvailable()
    got = {(r["Planilha"], r["Escola"]): (r["Media"], r["Valores_Utilizados"])
           for r in spark.sql("SELECT * FROM gs_means_test").collect()}
    q.stop()
    assert got == {("s1", "A"): (77.75, 1), ("s1", "B"): (50.0, 1), ("s2", "A"): (15.0, 1)}


def test_watch_sheets(spark, tmpdir_fresh):
    folder = os.path.join(tmpdir_fresh, "landing")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write("nome,nota1,nota2\nX,7,9\nY,5,\n")
    q = ST.watch_sheets(spark, folder, "nome string, nota1 string, nota2 string", "nome", ["nota1", "nota2"],
                        os.path.join(tmpdir_fresh, "ck"), name="gs_watch_test")
    q.processAllAvailable()
    with open(os.path.join(folder, "b.csv"), "w") as f:
        f.write("nome,nota1,nota2\nX,1,3\n")
    q.processAllAvailable()
    got = {(r["Planilha"], r["Escola"]): r["Media"] for r in spark.sql("SELECT * FROM gs_watch_test").collect()}
    q.stop()
    assert got == {("a.csv", "X"): 8.0, ("a.csv", "Y"): 5.0, ("b.csv", "X"): 2.0}


def test_watch_sheets_to_files(spark, tmpdir_fresh):
    """Batches on disk give the present means, also after a restart."""
    folder, path = os.path.join(tmpdir_fresh, "landing"), os.path.join(tmpdir_fresh, "means")
    os.makedirs(folder)
    for name, text in (("a.csv", "X,7,9\nY,5,\n"), ("b.csv", "X,1,3\nX,5,7\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write("nome,nota1,nota2\n" + text)
        q = ST.watch_sheets(spark, folder, "nome string, nota1 string, nota2 string", "nome", ["nota1", "nota2"],
                            os.path.join(tmpdir_fresh, "ck"), trigger_once=True, path=path)
        q.awaitTermination()
    got = {(r["Planilha"], r["Escola"]): (r["Media"], r["Valores_Utilizados"]) for r in ST.latest_means(spark, path).collect()}
    assert got == {("a.csv", "X"): (8.0, 1), ("a.csv", "Y"): (5.0, 1), ("b.csv", "X"): (4.0, 2)}


def test_many_analyses_are_one_append(spark, tmpdir_fresh):
    from gridscope.operators.history import HistoryStore
    store = HistoryStore(spark, tmpdir_fresh)
    assert store.read("analyses").count() == 0
    store.save_analyses([{"id": i, "session_id": "s", "filename": f"f{i}", "file_type": "csv", "analysis": {"n": i}, "insights": [],
                          "charts": [], "statistics": {}} for i in range(5)])
    assert sorted(r["id"] for r in store.read("analyses").collect()) == list(range(5))
    files = [f for _, _, names in os.walk(store.path("analyses")) for f in names if f.endswith(".parquet")]
    assert 1 <= len(files) <= spark.sparkContext.defaultParallelism
    with open(os.path.join(store.path("system_logs")), "w") as f:  # not a table: an error, not an empty one
        f.write("x")
    with pytest.raises(Exception):
        store.read("system_logs").count()
