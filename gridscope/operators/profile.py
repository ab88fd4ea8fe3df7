"""Column and table profiles (C11-C17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.columns import c, num
from gridscope.operators.aggregates import long_value_counts, to_long
from gridscope.operators.order import quantile_columns
from gridscope.operators.semantic import TIME_TYPES, as_text, structural_types, value_table

# Name fragments that mark a possible date/time column
TIME_NAME_WORDS = ["data", "date", "tempo"]
# Column descriptions by structural type
DESCRIPTIONS = {
    "numeric": "Coluna numérica com %d valores únicos de %d registros",
    "categorical": "Coluna categórica com %d categorias distintas",
    "datetime": "Coluna de datas com %d datas únicas",
    "text": "Coluna de texto com %d valores únicos",
}


def column_profile(df: DataFrame, n_samples: int = 5) -> DataFrame:
    """C11: one row per column: structural type, null count and %, distinct
    count and % of non-null, and ``n_samples`` sample values (the smallest
    distinct values as text: deterministic, unlike "first rows")."""
    cols = df.columns
    vt = value_table(df, cols)  # the one scan and shuffle over rows
    rows = vt.filter(F.col("column") == cols[0]).agg(F.sum("count")).first()[0] or 0 if cols else 0
    vc = vt.filter(F.col("value").isNotNull())
    types = structural_types(df, cols, vc)
    samples = _samples(vc, n_samples)
    nulls = F.lit(rows) - F.col("non_null")
    return (types.join(samples, "column", "left").select(
        "column", "type", nulls.alias("null_count"),
        (nulls / F.lit(rows) * 100 if rows else F.lit(0.0)).alias("null_pct"),
        "distinct",
        F.when(F.col("non_null") > 0, F.col("distinct") / F.col("non_null") * 100).otherwise(F.lit(0.0))
        .alias("distinct_pct"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        _description().alias("description")))


def _description():
    d = F.col("distinct")
    return (F.when(F.col("type") == "numeric", F.format_string(DESCRIPTIONS["numeric"], d, F.col("non_null")))
            .when(F.col("type") == "categorical", F.format_string(DESCRIPTIONS["categorical"], d))
            .when(F.col("type") == "datetime", F.format_string(DESCRIPTIONS["datetime"], d))
            .otherwise(F.format_string(DESCRIPTIONS["text"], d)))


def _samples(vc: DataFrame, k: int) -> DataFrame:
    """k smallest values per column without collecting whole groups: a
    bounded top-k aggregate (``min_by`` chains would need k passes)."""
    from pyspark.sql import Window
    # two rounds of a bounded top-k: first inside (column, hash salt) slices,
    # then over at most 64 * k survivors per column
    salted = vc.withColumn("_salt", F.abs(F.hash("value")) % 64)
    w1 = Window.partitionBy("column", "_salt").orderBy("value")
    first = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy("column").orderBy("value")
    return (first.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)
            .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples")))


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min, max, mean, median, std, IQR outlier count and a distribution
    label from pandas' bias-corrected skew (|G1| < 0.5 normal, > 0.5
    right_skewed, otherwise left_skewed - also when the skew is undefined).
    The per-column quartiles are collected and enter the single final
    aggregate as literals."""
    from gridscope.operators.aggregates import literal_map
    long = to_long(df, cols)
    qs = quantile_columns(long, "value", {"_q1": 0.25, "median": 0.5, "_q3": 0.75}, by=["column"]).collect()
    lo = literal_map([{"column": r["column"], "v": r["_q1"] - 1.5 * (r["_q3"] - r["_q1"])} for r in qs], "column", "v")
    hi = literal_map([{"column": r["column"], "v": r["_q3"] + 1.5 * (r["_q3"] - r["_q1"])} for r in qs], "column", "v")
    med = literal_map(qs, "column", "median")
    v = F.col("value")
    base = long.groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.count("value").alias("_n"), F.skewness("value").alias("_g1"),
        F.count_if((v < lo[F.col("column")]) | (v > hi[F.col("column")])).alias("outliers_count"))
    n = F.col("_n")
    g = F.when(n >= 3, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    dist = F.when(F.abs(g) < 0.5, "normal").when(g > 0.5, "right_skewed").otherwise("left_skewed")
    return base.select("column", "min", "max", "mean", med[F.col("column")].alias("median"), "std",
                       "outliers_count", dist.alias("distribution_type"))


def categorical_profile(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Per column the top value and its count, and 'balanced' when the
    sample std of the category counts is below their mean (one category ->
    'skewed').  The top-k list is returned by ``value_counts``."""
    from gridscope.operators.aggregates import top_values
    vc = long_value_counts(df, cols)
    agg = vc.groupBy("column").agg(
        F.min_by("value", F.struct(F.negative("count"), F.col("value"))).alias("most_frequent"),
        F.max("count").alias("frequency_of_most"),
        F.count("value").alias("categories"),
        F.when(F.stddev_samp("count") < F.avg("count"), "balanced").otherwise("skewed").alias("category_distribution"))
    return agg.join(top_values(vc, k), "column", "left").withColumnRenamed("top_values", "top_categories")


def datetime_profile(df: DataFrame, col: str) -> DataFrame:
    """C14: min / max date as yyyy-MM-dd, whole days between them, and the
    G11 frequency label."""
    from gridscope.operators.timeseries import date_frequency
    from gridscope.functions.columns import epoch_micros, utc_day
    d = df.select(epoch_micros(df, col).alias("_us")).filter(F.col("_us").isNotNull())
    rng = d.agg(F.min("_us").alias("_mn"), F.max("_us").alias("_mx"))
    days = F.floor((F.col("_mx") - F.col("_mn")) / 86_400_000_000).cast("long")
    out = rng.select(F.lit(col).alias("column"), F.date_format(utc_day(F.col("_mn")), "yyyy-MM-dd").alias("min_date"),
                     F.date_format(utc_day(F.col("_mx")), "yyyy-MM-dd").alias("max_date"), days.alias("date_range_days"))
    return out.crossJoin(date_frequency(d.select(F.timestamp_micros("_us").alias("_t")), "_t")
                         .select("frequency_pattern"))


def data_quality(df: DataFrame) -> DataFrame:
    """Completeness %, missing %, columns with NULLs, duplicate rows and
    the (constant) consistency score, in one row."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(c(x).isNull()).alias(f"z{i}") for i, x in enumerate(cols)])
    nulls = sum((F.col(f"z{i}") for i in range(len(cols))), F.lit(0))
    cells = F.col("rows") * len(cols)
    dup_rows = df.groupBy(*[c(x) for x in cols]).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    with_nulls = F.filter(F.array(*[F.when(F.col(f"z{i}") > 0, F.lit(x)) for i, x in enumerate(cols)]),
                          lambda v: v.isNotNull())
    return agg.crossJoin(dup_rows).select(
        (F.try_divide(cells - nulls, cells) * 100).alias("completeness_score"),
        (F.try_divide(nulls, cells) * 100).alias("missing_data_percentage"),
        with_nulls.alias("columns_with_nulls"),
        F.col("duplicate_rows").cast("long").alias("duplicate_rows"),
        F.lit(100.0).alias("data_consistency_score"))


def summary_stats(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of numeric / text / datetime columns."""
    t = [x for _, x in df.dtypes]
    num = sum(1 for x in t if x in {"tinyint", "smallint", "int", "bigint", "float", "double"} or x.startswith("decimal"))
    txt = sum(1 for x in t if x == "string")
    dt = sum(1 for x in t if x in TIME_TYPES)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(t)).cast("long").alias("total_columns"),
        F.lit(num).cast("long").alias("numeric_columns"), F.lit(txt).cast("long").alias("text_columns"),
        F.lit(dt).cast("long").alias("datetime_columns"))


def structure_patterns(df: DataFrame) -> DataFrame:
    """C17: ``(column, pattern)`` rows: id_like (distinct / rows > 0.95),
    few_values (<= 3 distinct and more than 10 rows), high_missing (> 50 %
    NULL) and time_name (name contains data/date/tempo)."""
    rows = df.count()
    cols = df.columns
    vc = long_value_counts(df.select(*[as_text(df, x).alias(x) for x in cols]), cols)
    st = vc.groupBy("column").agg(F.count("value").alias("distinct"), F.sum("count").alias("non_null"))
    allc = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    st = allc.join(st, "column", "left").fillna(0, ["distinct", "non_null"])
    name_hit = F.lit(False)
    for w in TIME_NAME_WORDS:
        name_hit = name_hit | F.lower("column").contains(w)
    pats = F.array(
        F.when(F.col("distinct") / F.lit(max(rows, 1)) > 0.95, F.lit("id_like")),
        F.when((F.col("distinct") <= 3) & F.lit(rows > 10), F.lit("few_values")),
        F.when((F.lit(rows) - F.col("non_null")) / F.lit(max(rows, 1)) * 100 > 50, F.lit("high_missing")),
        F.when(name_hit, F.lit("time_name")))
    return st.select("column", "distinct", F.explode(F.filter(pats, lambda v: v.isNotNull())).alias("pattern"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in {"tinyint", "smallint", "int", "bigint", "float", "double"}
            or t.startswith("decimal")]


def to_numeric_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[num(df, x).alias(x) for x in cols])
