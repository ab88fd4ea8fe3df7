"""Descriptive aggregates.

Wide tables are handled in long form ``(column, value)`` so that k columns
cost one scan and one shuffle instead of k jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions.columns import c, num
from gridscope.operators.order import quantile_columns, quantiles


def to_long(df: DataFrame, cols: list[str], value_type: str = "double",
            keep: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` to ``(keep..., column, value)``; NULL values dropped."""
    keep = list(keep or [])
    cast = (lambda x: num(df, x)) if value_type == "double" else (lambda x: c(x).cast(value_type))
    arr = F.array(*[F.struct(F.lit(x).alias("column"), cast(x).alias("value")) for x in cols])
    return (df.select(*[c(k) for k in keep], F.inline(arr))
            .filter(F.col("value").isNotNull()))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 %, max per column (long form)."""
    long = to_long(df, cols)
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = quantile_columns(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by=["column"])
    return basic.join(qs, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population skewness / excess kurtosis, pandas' bias-corrected skew,
    coefficient of variation (sample std / mean, 0 when the mean is 0),
    range, geometric and harmonic mean over positive values."""
    long = to_long(df, cols)
    n = F.count("value")
    g1 = F.skewness("value")
    pos = F.when(F.col("value") > 0, F.col("value"))
    agg = long.groupBy("column").agg(
        n.alias("n"), g1.alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"),
        (F.max("value") - F.min("value")).alias("range"),
        F.exp(F.avg(F.ln(pos))).alias("geometric_mean"),
        (F.count(pos) / F.sum(1.0 / pos)).alias("harmonic_mean"))
    corrected = F.when(F.col("n") >= 3, F.col("skewness") * F.sqrt(F.col("n") * (F.col("n") - 1))
                       / (F.col("n") - 2))
    cv = F.when(F.col("_mean") != 0, F.col("_std") / F.col("_mean")).otherwise(F.lit(0.0))
    return agg.select("column", "n", "skewness", "kurtosis", corrected.alias("skew_corrected"),
                      cv.alias("cv"), "range", "geometric_mean", "harmonic_mean")


def literal_map(rows, key: str, value: str):
    """A small collected result (one row per column) as a map literal, so a
    later pass uses it as a constant instead of re-running its aggregate."""
    pairs = [x for r in rows if r[value] is not None for x in (F.lit(r[key]), F.lit(float(r[value])))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def robust_spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """IQR and MAD (median of |x - median|, unscaled), exact, per column.
    The medians (one per column) are collected and used as literals by the
    second pass."""
    spark = df.sparkSession
    long = to_long(df, cols)
    qs = quantile_columns(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=["column"]).collect()
    med = literal_map(qs, "column", "median")
    dev = long.select("column", F.abs(F.col("value") - med[F.col("column")]).alias("dev"))
    mad = quantiles(dev, "dev", [0.5], by=["column"]).select("column", F.col("q").alias("mad"))
    qdf = spark.createDataFrame([(r["column"], r["q25"], r["median"], r["q75"]) for r in qs],
                                "column string, q25 double, median double, q75 double")
    return qdf.join(mad, "column", "left").select(
        "column", "q25", "median", "q75", (F.col("q75") - F.col("q25")).alias("iqr"), "mad")


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Frequency table, count desc then value asc (a total order); top ``k``."""
    vc = (df.filter(c(col).isNotNull()).groupBy(c(col).alias("value"))
          .agg(F.count(F.lit(1)).alias("count")))
    ordered = vc.orderBy(F.desc("count"), F.asc("value"))
    return ordered.limit(k) if k else ordered


def long_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, count)`` for many columns in one shuffle (values as text)."""
    long = to_long(df, cols, value_type="string")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(vc: DataFrame, k: int = 10, group: str = "column") -> DataFrame:
    """The ``k`` most frequent values per column from a ``(column, value,
    count)`` table, as an ordered array of (value, count) structs (count desc,
    value asc).  Two rounds of a bounded top-k - inside (column, hash salt)
    slices, then over at most 64 x k survivors - so a column with a huge
    number of distinct values is never ranked by one task."""
    salted = vc.withColumn("_salt", F.abs(F.hash("value")) % 64)
    w1 = Window.partitionBy(group, "_salt").orderBy(F.desc("count"), "value")
    first = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(group).orderBy(F.desc("count"), "value")
    top = first.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)
    return top.groupBy(group).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_r", "value", "count"))),
        lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias("top_values"))


def frequency_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: distinct count, most/least frequent value + counts,
    concentration ratio (top count / non-null) and entropy in bits (D9-D12).

    Order of the frequency table is count desc, value asc; "least frequent" is
    its last entry.  One shuffle for all columns, one aggregate over the
    (column, value) counts."""
    vc = long_value_counts(df, cols)
    n = F.sum("count")
    agg = vc.groupBy("column").agg(
        F.count("value").alias("distinct"), n.alias("non_null"),
        F.min_by("value", F.struct(F.negative("count"), F.col("value"))).alias("most_frequent"),
        F.max("count").alias("most_frequent_count"),
        F.max_by("value", F.struct(F.negative("count"), F.col("value"))).alias("least_frequent"),
        F.min("count").alias("least_frequent_count"),
        F.sum(F.col("count") * F.log2("count")).alias("_clogc"))
    return agg.select(
        "column", "distinct", "non_null", "most_frequent", "most_frequent_count",
        "least_frequent", "least_frequent_count",
        (F.col("most_frequent_count") / F.col("non_null")).alias("concentration"),
        (F.log2("non_null") - F.col("_clogc") / F.col("non_null")).alias("entropy"))


def mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent numeric value, smallest on ties."""
    long = to_long(df, cols)
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return vc.groupBy("column").agg(
        F.min_by("value", F.struct(F.negative("count"), F.col("value"))).alias("mode"),
        F.max("count").alias("mode_count"))


def group_mean(df: DataFrame, keys: list[str], value: str, mean_name: str = "mean",
               count_name: str = "count") -> DataFrame:
    """Mean and non-null count per key (partial aggregation map-side)."""
    return df.groupBy(*[c(k) for k in keys]).agg(
        F.avg(c(value)).alias(mean_name), F.count(c(value)).alias(count_name))


def group_median_argmax(df: DataFrame, cat: str, value: str) -> DataFrame:
    """Median per category and the category with the highest median."""
    med = quantiles(df.filter(c(cat).isNotNull()), value, [0.5], by=[cat]).select(
        c(cat).alias("category"), F.col("q").alias("median"))
    # highest median; on ties the smallest category
    best = med.agg(F.min_by("category", F.struct(F.negative("median"), F.col("category"))).alias("best"))
    return med.crossJoin(F.broadcast(best)).withColumn("is_highest", F.col("category") == F.col("best")).drop("best")


def pivot_mean(df: DataFrame, index: str, columns: str, value: str,
               values: list | None = None) -> DataFrame:
    """index x columns matrix of means."""
    g = df.groupBy(c(index))
    g = g.pivot(columns, values) if values is not None else g.pivot(columns)
    return g.agg(F.avg(c(value)))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form ``(a, b, count)`` (D18); pivot for display."""
    return df.groupBy(c(a), c(b)).agg(F.count(F.lit(1)).alias("count"))


def crosstab_matrix(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    g = df.groupBy(c(a))
    g = g.pivot(b, values) if values is not None else g.pivot(b)
    return g.agg(F.count(F.lit(1))).fillna(0)


def group_sizes(df: DataFrame, cols: list[str], with_parents: bool = True) -> DataFrame:
    """Counts per hierarchy path (D19); parent levels via ``rollup``."""
    if with_parents:
        lvl = F.lit(len(cols)) - sum((F.grouping(c(x)).cast("int") for x in cols), F.lit(0))
        return (df.rollup(*[c(x) for x in cols])
                .agg(F.count(F.lit(1)).alias("count"), lvl.alias("level")))
    return df.groupBy(*[c(x) for x in cols]).agg(F.count(F.lit(1)).alias("count"))


def row_mean(df: DataFrame, cols: list[str], keep: list[str],
             mean_name: str = "Media", count_name: str = "Valores_Utilizados") -> DataFrame:
    """Per row: mean and count of the parsable values in ``cols``; rows with
    none are dropped (D22).  Pure row-wise expressions, no shuffle."""
    vals = F.filter(F.array(*[num(df, x) for x in cols]), lambda v: v.isNotNull())
    return (df.select(*[c(k) for k in keep], vals.alias("_vals"))
            .filter(F.size("_vals") > 0)
            .select(*[c(k) for k in keep],
                    (F.aggregate("_vals", F.lit(0.0), lambda a, v: a + v) / F.size("_vals")).alias(mean_name),
                    F.size("_vals").cast("long").alias(count_name)))


def top_k(df: DataFrame, by: list[str], k: int, ascending: bool = False,
          tiebreak: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows by ``by`` (a bounded top-k sort:
    TakeOrderedAndProject), ties broken by ``tiebreak`` ascending."""
    order = [c(x).asc() if ascending else c(x).desc() for x in by] + [c(x).asc() for x in tiebreak or []]
    return df.orderBy(*order).limit(k)


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """Non-null distinct values per column.  Exact: one ``(column, value)``
    shuffle of the distinct pairs.  ``approx``: one aggregate of HLL sketches
    (no shuffle of values; relative error ``rsd``) for very wide or very large
    tables."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(c(x), rsd).alias(f"d{i}") for i, x in enumerate(cols)])
        return row.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"d{i}").alias("distinct"))
                                             for i, x in enumerate(cols)])))
    return long_value_counts(df, cols).groupBy("column").agg(F.count("value").alias("distinct"))
