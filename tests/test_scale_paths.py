"""End-to-end queries give the same answer when every group is forced
through the scalable (range-bucketed / value-count) plans."""

import pytest

import __spark_entry__ as E
from gridscope.operators import order as O
from tools.oracle_check import compare
from paths import SF_MID

NAMES = ["score_ranking", "robust_spread", "describe_numeric", "spearman_pairs", "kendall_pairs",
         "index_trend", "acf", "box_by_category", "mann_whitney_u", "hier_records"]


@pytest.mark.parametrize("name", NAMES)
def test_small_buckets_same_result(spark, monkeypatch, name):
    q = E.queries()[name]
    default = q(spark, SF_MID).toPandas()
    monkeypatch.setattr(O, "BUCKETS", 40)
    forced = q(spark, SF_MID).toPandas()
    r = compare(forced, default)
    assert r is None or r.startswith("strict-diff"), f"{name}: {r}"
