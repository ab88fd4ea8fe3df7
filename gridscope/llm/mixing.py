"""Operator 8: mixing sources to target weights by Pareto order sampling.

Native: DataFrame functions only.

Every source gets a target number of words (weights by rank, a share of all
words, never above ``max_copies`` times the source; excess is shared out again by
weight).  A document's expected copies are ``target / source words`` times its
optional ``weight`` over the source's mean weight.  The whole part of that is
certain; the fraction ``pi`` is an inclusion probability.  Documents are ranked
by ``odds(u) / odds(pi)`` with a reproducible uniform ``u`` (Pareto order
sampling), and the lowest ranks are taken until the source's remaining words
are reached: a fixed-size sample with unequal probabilities.

No source is sorted whole: ranks fall into ``BINS`` bins per source, the bin in
which the target is reached comes from the bin totals, and only that bin's rows
are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscope.llm.common import WORD, documents, joined_small, stored, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BINS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """52 bits of md5 over id and text, in (0, 1): equal on every run."""
    h = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a
    source.  Sources weigh ``weights`` in code point order, repeating, null last.
    The windows run over sources, never over documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * max_copies)
    # Sources reach their cap in the order of cap / weight.
    order = [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = (t.withColumn("_free", F.sum("source_size").over(every) * float(share)
                      - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_left", F.sum("_w").over(after)))
    full = F.col("_cap") * F.col("_left") <= F.col("_free") * F.col("_w")
    t = t.withColumn("_full", full)
    # The first source below its cap has the most weight left behind it.
    t = t.withColumn("_lv", F.max(F.when(~F.col("_full"), F.struct("_left", "_free"))).over(every))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
        F.col("_lv._free") * F.col("_w") / F.col("_lv._left"))
    return t.select("source", "source_size", target.alias("target"))


def _expected(weighted: bool) -> Column:
    """Expected copies of a row, at most the cap that the target already keeps."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if weighted:
        rate = F.least(F.lit(float(MAX_COPIES)),
                       rate * F.coalesce(F.col("_wt"), F.lit(0.0)) * F.col("source_size") / F.col("_wsum"))
    return rate


def _ranked(rows: DataFrame, weighted: bool) -> DataFrame:
    e = _expected(weighted)
    rows = rows.withColumn("_e", e).withColumn("_whole", F.when(F.col("size") > 0, F.floor("_e")).otherwise(0)).withColumn("_pi", F.col("_e") - F.floor("_e"))
    odds_u = F.col("_u") / (1.0 - F.col("_u"))
    odds_pi = F.col("_pi") / (1.0 - F.col("_pi"))
    return rows.withColumn("_key", F.when((F.col("_pi") > 0) & (F.col("size") > 0), odds_u / odds_pi))


def plan(slim: DataFrame, weighted: bool = False, weights=WEIGHTS, share: float = SHARE,
         max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: source_size, target, and ``cut``, the largest rank taken."""
    sums = [F.sum("size").alias("source_size")]
    if weighted:
        sums.append(F.sum(F.col("size") * F.coalesce(F.col("_wt"), F.lit(0.0))).alias("_wsum"))
    per = slim.groupBy("source").agg(*sums)
    t = source_targets(per.select("source", "source_size"), weights, share, max_copies)
    if weighted:
        t = joined_small(t, per.select("source", "_wsum"), ["source"])
    t = stored(t, "mix-targets")
    rows = _ranked(joined_small(slim, t, ["source"]), weighted)
    whole = rows.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure"))
    rows = rows.filter(F.col("_key").isNotNull()).withColumn(
        "_bin", F.floor(F.col("_key") / (1.0 + F.col("_key")) * BINS).cast("int"))
    need = joined_small(t, whole, ["source"]).withColumn("_need", F.col("target") - F.col("_sure"))
    need = stored(need.select("source", "_need"), "mix-need")
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy("source").orderBy("_bin")
    bins = bins.withColumn("_cum", F.sum("_s").over(upto))
    cutbin = (joined_small(bins, need, ["source"]).filter(F.col("_cum") >= F.col("_need"))
              .groupBy("source").agg(F.min_by(F.struct("_bin", (F.col("_cum") - F.col("_s")).alias("_before"), "_need"),
                                              F.col("_bin")).alias("_c")))
    cutbin = stored(cutbin, "mix-bins")
    near = joined_small(rows, cutbin, ["source"], "inner").filter(F.col("_bin") == F.col("_c._bin"))
    ordered = Window.partitionBy("source").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_upto", F.col("_c._before") + F.sum("size").over(ordered))
    # A document that crosses the target stays when that ends nearer to it.
    cut = (near.filter(F.col("_upto") - F.col("size") / 2.0 <= F.col("_c._need"))
           .groupBy("source").agg(F.max("_key").alias("_last")))
    out = joined_small(joined_small(t, cutbin.select("source", F.col("_c._bin").alias("_cutbin")), ["source"]), cut, ["source"])
    return stored(out, "mix-cuts")


def _copies(rows: DataFrame, weighted: bool) -> DataFrame:
    rows = _ranked(rows, weighted)
    b = F.floor(F.col("_key") / (1.0 + F.col("_key")) * BINS).cast("int")
    more = F.when(F.col("_key").isNull(), False).when(F.col("_cutbin").isNull(), True).otherwise(
        (b < F.col("_cutbin")) | ((b == F.col("_cutbin")) & F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False))))
    return rows.withColumn("copies", F.col("_whole") + more.cast("long"))


def mix(docs: DataFrame, weight: str | None = None, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` (doc_id, text, source and any further columns), each row as
    often as the mixture takes it.

    Null or wordless texts have size 0 and are not taken.  A null source is a
    source of its own, last in order.  Repeated rows (equal id and text) share
    one random number and are taken alike.  An empty table gives an empty one.
    Further columns are carried along, whatever their names."""
    keep = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    rows = packed.select("_row", F.col("_row.source").alias("source"), words(F.col("_row.text")).alias("size"),
                         uniform(F.col("_row.doc_id"), F.col("_row.text")).alias("_u"),
                         *([F.col(f"_row.`{weight}`").cast("double").alias("_wt")] if weight else []))
    p = plan(stored(rows.drop("_row"), "mix-slim"), bool(weight), weights, share)
    out = _copies(joined_small(rows, p, ["source"]), bool(weight))
    out = out.filter("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    slim = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                              uniform(F.col("doc_id"), F.col("text")).alias("_u")), "mix-slim")
    out = _copies(joined_small(slim, plan(slim), ["source"]), False)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE
          + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
               ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
             sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, cap * rest <= free * w AS is_full FROM f),
lv AS (SELECT free, rest FROM g WHERE NOT is_full ORDER BY rest DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE
             ELSE (SELECT free FROM lv) * w / (SELECT rest FROM lv) END AS target FROM g),
e AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 THEN floor(e) ELSE 0 END AS whole, CASE WHEN e > floor(e) AND size > 0
             THEN (u / (1.0 - u)) / ((e - floor(e)) / (1.0 - (e - floor(e)))) END AS key FROM e),
c AS (SELECT *, sum(CASE WHEN key IS NOT NULL THEN size ELSE 0 END) OVER (
               PARTITION BY source ORDER BY key NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             target - sum(whole * size) OVER (PARTITION BY source) AS need FROM k)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT *, (whole + CASE WHEN key IS NOT NULL AND upto - size / 2.0 <= need THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM c)
"""
