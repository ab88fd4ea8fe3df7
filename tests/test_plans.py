"""Physical-plan properties that matter at scale."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from gridscope.operators import aggregates as A
from paths import SF_MID


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_pre_aggregates(spark):
    # the means that the ranking stores before it orders them
    df = E.queries()["entity_means"](spark, SF_MID)
    plan = _plan(df)
    assert "CartesianProduct" not in plan
    # orders are partially aggregated before any shuffle
    assert "functions=[partial_" in plan
    txt = df._jdf.queryExecution().toString()
    assert "o_orderdate" not in txt.split("== Physical Plan ==")[1]  # unused column never read


def test_wide_statistics_are_one_scan(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    plan = _plan(A.moments(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    assert plan.count("FileScan") == 1


def test_top_values_order(spark):
    vc = spark.createDataFrame([("c", "x", 5), ("c", "a", 5), ("c", "b", 7), ("c", "z", 1), ("d", "q", 2)],
                               "column string, value string, count long")
    got = {r["column"]: [(s["value"], s["count"]) for s in r["top_values"]] for r in A.top_values(vc, 3).collect()}
    assert got == {"c": [("b", 7), ("a", 5), ("x", 5)], "d": [("q", 2)]}


def test_value_counts_is_a_top_k_sort(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    plan = _plan(A.value_counts(li, "l_partkey", 20))
    assert "TakeOrderedAndProject" in plan


def test_no_cartesian_products(spark):
    """No registered query pairs up rows of two unbounded inputs."""
    from paths import SF_SMALL
    bad = []
    for name, q in sorted(E.queries().items()):
        plan = _plan(q(spark, SF_SMALL))
        if "CartesianProduct" in plan:
            bad.append(name)
    assert bad == []


def test_no_single_task_over_raw_rows(spark):
    """Between a given table and a single-partition exchange there is always an
    aggregate, a top-k or a limit."""
    import re

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    bad = []
    for name, q in sorted(E.queries().items()):
        if name.startswith("op") or name == "pipeline":
            continue
        lines = _plan(q(spark, SF_MID)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            for below in lines[i + 1:]:
                if depth(below) <= depth(line) or re.search("Aggregate|TakeOrdered|LocalLimit", below):
                    break
                if "FileScan" in below and SF_MID in below:
                    bad.append((name, below.strip()[:80]))
                    break
    assert bad == []


def test_cluster_without_shared_folder_is_an_error():
    import pytest
    from gridscope import session
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.local_checkpoint_dir(master)
    assert session.local_checkpoint_dir("local[4]")


def test_written_tables_can_be_released(spark):
    import os
    from gridscope import session
    df = session.materialize(spark.range(5), "probe")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file:"))
    assert os.path.isdir(folder) and session.release(spark) >= 1 and not os.path.exists(folder)
