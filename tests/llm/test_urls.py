"""Operator 12: the sort-merge range join against a rule-by-rule loop."""

import random

import duckdb
import pytest

from gridscope.llm import urls
from gridscope.operators import order

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def by_loop(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def run(spark, rows, rules):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = urls.judged(df, urls.rule_table(spark, rules)).select("page.page_id", "page.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_loop(r["url"], rules), r["url"]


@pytest.mark.parametrize("buckets", [None, 23])
def test_random_rules(spark, monkeypatch, buckets):
    """Nested hosts and paths, also where stacks reach over bucket bounds."""
    monkeypatch.setattr(order, "BUCKETS", buckets)
    rnd = random.Random(5)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "x", "y", "/x", "\u00e9"]) for _ in range(rnd.randint(0, 5)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((host(), "/" + path() if rnd.random() < 0.8 else "") for _ in range(60))}.values())
    rows = [(i, f"http://{host()}{'/' + path() if rnd.random() < 0.9 else ''}{rnd.choice(['', '?q=/x', '#/y'])}", "h") for i in range(700)]
    run(spark, rows, rules)


def test_odd_urls(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "no scheme", None), (4, "://", None), (5, "http://NET/", None), (6, "http://net", None),
            (7, "http://a.net?x=/", None), (8, "http://anet/", None), (9, "x://y://net/", None), (10, "http://Example.NET/en/" + "p" * 100_000, None),
            (11, "http://net.//", None), (None, "http://net/", None), (5, "http://NET/", None), (12, "http://..net/", None), (13, "http://\u00c4.net/", None)]
    run(spark, rows, urls.RULES)
    run(spark, rows, ())


def test_repeated_rules_block(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "")], SCHEMA)
    got = urls.judged(df, urls.rule_table(spark, [("a.b", "/", "allow"), ("A.b", "/", "block"), ("b", "/", "allow")])).first()
    assert got["verdict"] == "block"


def test_rows_and_clashing_columns(spark, with_clashes):
    df = spark.createDataFrame([(1, "http://a.net/", "t"), (1, "http://a.net/", "t"), (2, "http://a.com/de", "u"), (3, "http://example.com/de/", None)], SCHEMA)
    df = with_clashes(df).selectExpr("*", "'r' AS rule", "'v' AS verdict", "'p' AS path", "'s' AS host", "'b' AS b", "1 AS _gs_b", "'k' AS `a.k`")
    out = urls.allowed(df, urls.rule_table(df.sparkSession, urls.RULES))
    assert out.columns == df.columns and out.collect() == df.filter("page_id = 2").collect()
    assert urls.judged(df.limit(0), urls.rule_table(df.sparkSession, urls.RULES)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(con.execute(urls.OP12_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in urls.op12_url_filters(spark, sf).collect()), key=str)
    assert got == want and {r[4] for r in got} == {"allow", "block"}


def test_no_python_and_no_single_task(spark):
    plan = urls.op12_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "ExistingRDD"))
