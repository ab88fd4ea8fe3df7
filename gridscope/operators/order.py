"""Order-dependent primitives that never put a whole column into one task.

Spark has no cheap global "row number": an un-partitioned window moves every
row into a single task.  All order statistics here (running totals, positions,
ranks, exact quantiles, neighbours) use one plan at every size:

1. the needed columns are dealt into range buckets on the *full* sort key (groups,
   then all order columns) and written once with their bucket number.  Spark
   samples the bounds; because the key has all order columns, a frequent value is
   split on the rest of the key.  The session's shuffle partitions bound the number
   of buckets whatever the number of rows, and adaptive execution merges neighbouring
   small ones up to its advisory size in bytes, so a bucket is sized by bytes;
2. each bucket is totalled (a tiny table: one row per bucket and group in it) and
   the totals become running offsets;
3. an ordered window inside ``(group, bucket)``, which sorts with spill, gives the rest.

Neighbours across buckets come from an edge table: the last k rows of a bucket,
joined to the buckets that need them by bucket number.

Buckets are range buckets, so the order across buckets is known without any
shuffle of raw rows into one place, and no group is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions.columns import c
from gridscope.session import materialize

# A fixed number of buckets instead of Spark's choice (tests make it large).
BUCKETS: int | None = None


def deal(df: DataFrame, keys: list[str], n_buckets: int | None = None) -> DataFrame:
    """``df``, stored in range buckets of ``keys``: column ``_gs_b`` numbers them in
    key order.  Rows with equal keys share a bucket."""
    n = n_buckets or BUCKETS
    columns = [c(k) for k in keys]
    ranged = df.repartitionByRange(n, *columns) if n else df.repartitionByRange(*columns)
    return materialize(ranged.withColumn("_gs_b", F.spark_partition_id()), "buckets")


def _attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of a per-key table; null keys match."""
    other = [x for x in per_key.columns if x not in keys]
    small = per_key.select(*[c(k).alias(f"_gs_key{i}") for i, k in enumerate(keys)], *other)
    same = reduce(lambda x, y: x & y, [c(k).eqNullSafe(F.col(f"_gs_key{i}")) for i, k in enumerate(keys)])
    return rows.join(small, same).drop(*[f"_gs_key{i}" for i in range(len(keys))])


def cumulative(df: DataFrame, order: list[str], by: list[str] | None = None,
               weight: str | None = None, n_buckets: int | None = None,
               out: str = "_cum") -> DataFrame:
    """Running total of ``weight`` (1 per row when None) in the total order
    ``(by..., order...)``, restarting per ``by`` group.

    Adds ``{out}`` (inclusive running total).  ``order`` must make rows unique
    inside each group for the result to be deterministic."""
    by = list(by or [])
    w = c(weight) if weight else F.lit(1)
    dealt = deal(df, by + list(order), n_buckets)
    part = by + ["_gs_b"]
    totals = dealt.groupBy(*[c(k) for k in part]).agg(F.sum(w).alias("_gs_tot"))
    before = Window.partitionBy(*[c(b) for b in by]).orderBy("_gs_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[c(k) for k in part], F.coalesce(F.sum("_gs_tot").over(before), F.lit(0)).alias("_gs_off"))
    inside = Window.partitionBy(*[c(k) for k in part]).orderBy(*[c(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("_gs_run", F.sum(w).over(inside))
    return _attach(run, offsets, part).select(*[c(x) for x in df.columns], (F.col("_gs_run") + F.col("_gs_off")).alias(out))


def dense_position(df: DataFrame, order: list[str], by: list[str] | None = None,
                   out: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """0-based position of every row in the order ``order`` (per ``by`` group)."""
    return cumulative(df, order, by, None, n_buckets, out="_gs_c").withColumn(
        out, F.col("_gs_c") - 1).drop("_gs_c")


def value_counts_long(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, cnt) with NULL values removed; map-side combined."""
    by = list(by or [])
    return (df.filter(c(value).isNotNull())
            .groupBy(*[c(b) for b in by], c(value)).agg(F.count(F.lit(1)).alias("cnt")))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None,
                  n_buckets: int | None = None) -> DataFrame:
    """Distinct values with their average rank (ties share the mean rank, 1-based).

    Returns ``(by..., value, cnt, avg_rank)``; join it back on ``(by, value)``
    to rank rows.  Runs over distinct values only.
    """
    by = list(by or [])
    vc = value_counts_long(df, value, by)
    cum = cumulative(vc, [value], by, "cnt", n_buckets, out="_cum")
    return cum.withColumn("avg_rank", F.col("_cum") - (F.col("cnt") - 1) / 2.0).drop("_cum")


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
              n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas ``quantile`` / ``quantile_cont``).

    Returns ``(by..., p, q)``.  Values are counted (map-side combined), and the
    two order statistics around each quantile are the values whose running
    counts cover them.  Without groups an empty input gives NULLs."""
    by = list(by or [])
    keys = [c(b) for b in by]
    cum = cumulative(value_counts_long(df, value, by), [value], by, "cnt", n_buckets, out="_cum")
    sizes = cum.groupBy(*keys).agg(F.max("_cum").alias("_n"))
    probes = sizes.select(*keys, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).withColumn(
        "_h", (F.col("_n") - 1) * F.col("p")).withColumn("_lo", F.floor("_h"))
    # One row per group: its probes travel to the group's values.
    probe = probes.groupBy(*keys).agg(F.collect_list(F.struct("p", "_h", "_lo", F.least(F.col("_lo") + 1, F.col("_n") - 1).alias("_hi"))).alias("_ps"))
    both = _attach(cum, probe, by) if by else cum.crossJoin(F.broadcast(probe))
    first = F.col("_cum") - F.col("cnt")
    hits = F.filter("_ps", lambda s: ((s["_lo"] >= first) & (s["_lo"] < F.col("_cum"))) | ((s["_hi"] >= first) & (s["_hi"] < F.col("_cum"))))
    rows = both.select(*keys, c(value).alias("_v"), first.alias("_f"), "_cum", F.explode(hits).alias("s"))
    low = F.max(F.when((F.col("s._lo") >= F.col("_f")) & (F.col("s._lo") < F.col("_cum")), F.col("_v")))
    high = F.max(F.when((F.col("s._hi") >= F.col("_f")) & (F.col("s._hi") < F.col("_cum")), F.col("_v")))
    picked = rows.groupBy(*keys, F.col("s.p").alias("p"), F.col("s._h").alias("_h")).agg(low.alias("_a"), high.alias("_b"))
    q = (F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a"))).alias("q")
    if by:
        return picked.select(*keys, "p", q)
    every = df.sparkSession.createDataFrame([(float(p),) for p in probs], "p double")
    return every.join(F.broadcast(picked.select("p", q)), "p", "left")


def quantile_columns(df: DataFrame, value: str, probs: dict[str, float],
                     by: list[str] | None = None) -> DataFrame:
    """``quantiles`` pivoted to one column per named probability."""
    by = list(by or [])
    long = quantiles(df, value, list(probs.values()), by)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name) for name, p in probs.items()]
    if by:
        return long.groupBy(*[c(b) for b in by]).agg(*aggs)
    return long.agg(*aggs)


def _bucket_starts(dealt: DataFrame) -> list[tuple[int, int, int]]:
    """(bucket, rows, rows before it) of every bucket; as many as Spark has dealt, at
    most the session's shuffle partitions."""
    out, before = [], 0
    for r in dealt.groupBy("_gs_b").agg(F.count(F.lit(1)).alias("n")).orderBy("_gs_b").collect():
        out.append((r["_gs_b"], r["n"], before))
        before += r["n"]
    return out


def _needs(starts: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """(source bucket, bucket, first position) wherever a bucket needs rows of an
    earlier one among the ``width`` before its first row."""
    out = []
    for i, (b, _, off) in enumerate(starts):
        for src, n, at in reversed(starts[:i]):
            if at + n <= off - width:
                break
            out.append((src, b, off - width))
    return out


def with_halo(df: DataFrame, order: list[str], width: int, n_buckets: int | None = None) -> DataFrame:
    """Rows in range buckets (``_gs_b``) with their 0-based position ``pos``; each bucket
    also gets the ``width`` rows before its first one, marked ``halo``.

    The last ``width`` rows of each bucket are its edge; edges go to the later buckets
    that start within ``width`` places, by bucket number.  ``width`` copies a bucket,
    and no join touches the other rows."""
    spark = df.sparkSession
    dealt = deal(df, list(order), n_buckets)
    starts = _bucket_starts(dealt)
    at = F.broadcast(spark.createDataFrame(starts, "_gs_b int, _gs_n long, _gs_off long"))
    inside = Window.partitionBy("_gs_b").orderBy(*[c(o) for o in order])
    rows = dealt.withColumn("_gs_r", F.row_number().over(inside)).join(at, "_gs_b").withColumn(
        "pos", F.col("_gs_off") + F.col("_gs_r") - 1)
    kept = [c(x) for x in df.columns]
    own = rows.select(*kept, "pos", "_gs_b", F.lit(False).alias("halo"))
    needs = _needs(starts, width) if width > 0 else []
    if not needs:
        return own
    edges = rows.filter(F.col("_gs_r") > F.col("_gs_n") - width).select(*kept, "pos", F.col("_gs_b").alias("_gs_src"))
    wanted = spark.createDataFrame(needs, "_gs_src int, _gs_b int, _gs_from long")
    halo = edges.join(F.broadcast(wanted), "_gs_src").filter("pos >= _gs_from").select(
        *kept, "pos", "_gs_b", F.lit(True).alias("halo"))
    return own.unionByName(halo)


def with_lags(df: DataFrame, order: list[str], cols: list[str], lags: int = 1, n_buckets: int | None = None) -> DataFrame:
    """Every row with its position ``pos`` and the values ``{col}_lag{k}`` of the k-th
    row before it (NULL where there is none), k = 1..``lags``; no self-join."""
    rows = with_halo(df, order, lags, n_buckets)
    inside = Window.partitionBy("_gs_b").orderBy("pos")
    got = rows.select("*", *[F.lag(c(x), k).over(inside).alias(f"{x}_lag{k}") for x in cols for k in range(1, lags + 1)])
    return got.filter("NOT halo").drop("halo", "_gs_b")
