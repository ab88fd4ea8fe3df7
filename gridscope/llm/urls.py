"""Operator 12: URL filters by a sort-merge range join.

Native: DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot
(``www.example.net`` is ``net.example.www.``), so that a host and all its
subdomains are one interval of keys: from the key to the key followed by a byte
that ends no UTF-8 text.  Intervals of prefixes are nested or apart.

``sweep`` joins points to such intervals.  Openings, closings and points are sorted
together into range buckets; the running sum of openings less closings is the height
of the stack of active rules, and its entry at a height is the last opening of that
height.  The stack with which a bucket begins is carried over from the buckets before
it, by a table of one row per bucket and height.

Rules have a host and a path.  A first sweep gives each distinct host its stack of
rule hosts, a second one each distinct (rule host, path) its longest path rule; the
longest over a host's stack is the rule of a (host, path), which the pages then meet
in one join.  No stage holds a host or rule in one task: points are distinct, and the
joins have one row a key on one side, so Spark splits hot keys on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscope.llm.common import stored
from gridscope.operators.order import deal
from gridscope.session import ship_package

#: (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSE, _OPEN, _POINT = 0, 1, 2


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(k, stack): for each point ``k`` (text) all ``prefixes`` (``k``, text) it starts
    with, shortest first; points without any are left out.  Both sides distinct."""
    b = F.encode("k", "UTF-8")
    opened = prefixes.select(b.alias("b"), F.lit(_OPEN).alias("kind"), "k")
    closed = prefixes.select(F.concat(b, F.unhex(F.lit("FF"))).alias("b"), F.lit(_CLOSE).alias("kind"), F.lit(None).cast("string").alias("k"))
    asked = points.select(b.alias("b"), F.lit(_POINT).alias("kind"), "k")
    events = deal(opened.unionAll(closed).unionAll(asked), ["b", "kind"])
    step = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)
    # Height with which each bucket begins: one row a bucket.
    earlier = Window.orderBy("_gs_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = events.groupBy("_gs_b").agg(F.sum(step).alias("_sum")).select(
        "_gs_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("_gs_b").orderBy("b", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_height(some: DataFrame) -> DataFrame:
        return some.join(F.broadcast(begins), "_gs_b").withColumn("height", F.col("base") + F.sum(step).over(here))

    # Points don't change the height, so the rules' heights need the rules alone.
    starts = stored(with_height(events.filter(F.col("kind") != _POINT)).filter(F.col("kind") == _OPEN).groupBy("_gs_b", "height").agg(
        F.max_by("k", "b").alias("top")), "url-tops")
    most = starts.agg(F.max("height")).first()[0]
    if not most:
        return points.select("k", F.array("k").alias("stack")).limit(0)
    grid = begins.crossJoin(starts.sparkSession.range(1, most + 1).select(F.col("id").alias("height")))
    below = Window.partitionBy("height").orderBy("_gs_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(starts, ["_gs_b", "height"], "left").withColumn("top", F.last("top", True).over(below))
    carried = carried.groupBy("_gs_b").agg(F.map_from_entries(F.collect_list(F.struct("height", "top"))).alias("carried"))
    run = with_height(events).join(F.broadcast(carried), "_gs_b")
    tops = [F.coalesce(F.last(F.when((F.col("kind") == _OPEN) & (F.col("height") == h), F.col("k")), True).over(here),
                       F.col("carried")[F.lit(h).cast("long")]).alias(f"_top{h}") for h in range(1, most + 1)]
    found = run.select("kind", "k", "height", *tops).filter((F.col("kind") == _POINT) & (F.col("height") > 0))
    return found.select("k", F.slice(F.array(*[F.col(f"_top{h}") for h in range(1, most + 1)]), F.lit(1), F.col("height").cast("int")).alias("stack"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(host, path, verdict) from tuples."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(x) for x in ("host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])))


def ruled(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those distinct (host, path) that a rule fits."""
    own = rules.select(host_key(F.translate("host", _UPPER, _LOWER)).alias("rk"), F.concat("host", "path").alias("rule"), "path", "verdict")
    # The same rule twice: once, and block where the verdicts differ.
    own = stored(own.groupBy("rk", "path").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict")), "url-rules")
    stacks = sweep(pairs.select(host_key(F.col("host")).alias("k")).distinct(), own.select(F.col("rk").alias("k")).distinct())
    near = pairs.withColumn("hk", host_key(F.col("host"))).join(stacks.withColumnRenamed("k", "hk"), "hk").select(
        "host", "path", F.explode("stack").alias("rk"))
    # A host has no "#", and no path has one.
    joined = F.concat(F.col("rk"), F.lit("#"), F.col("path"))
    near = stored(near.withColumn("k", joined), "url-near")
    paths = own.withColumn("k", joined)
    tops = sweep(near.select("k").distinct(), paths.select("k")).select("k", F.element_at("stack", -1).alias("rule_k"))
    best = tops.join(paths.select(F.col("k").alias("rule_k"), "rule", "verdict"), "rule_k").select("k", "rule", "verdict")
    hit = near.join(best, "k")
    order = F.struct(F.length("rule"), F.length("rk"))
    return hit.groupBy("host", "path").agg(F.max_by("rule", order).alias("rule"), F.max_by("verdict", order).alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page, host, path, rule, verdict) for every row of ``pages``; ``page`` is the whole
    row as a struct, so its columns may have any names.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts
    with the rule's.  The longest rule (host and path together; then the longer host)
    wins; the same rule twice blocks if either does.  ``default`` holds where no rule
    fits.  A null url, or one without ``://``, has an empty host and path, which no
    rule fits.  Repeated rows are judged alike and all stay; very long urls are judged
    whole.  Without rules, or without pages, nothing is blocked or returned."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")).select(
        "page", host_of(F.col(f"page.`{url}`")).alias("host"), path_of(F.col(f"page.`{url}`")).alias("path"))
    pairs = stored(pages.select(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")).filter("host <> ''").distinct(), "url-pairs")
    verdicts = stored(ruled(pairs, rules), "url-verdicts")
    return rows.join(verdicts, ["host", "path"], "left").select(
        "page", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The pages that the rules allow; same columns."""
    kept = judged(pages, rules, url, default).filter(F.col("verdict") == "allow")
    return kept.select(*[F.col(f"page.`{c}`").alias(c) for c in pages.columns])


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return judged(pages, rule_table(spark, RULES)).select("page.page_id", "host", "path", "rule", "verdict")


OP12_SQL = f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
p AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS (SELECT q.*, r.host || r.path AS rule, r.verdict, row_number() OVER (
        PARTITION BY q.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
      FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE place = 1
"""
