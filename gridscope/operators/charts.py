"""Chart datasets (K1-K19): the data behind each chart, never the drawing.

Every dataset is an aggregate whose size is set by the chart (bins, top-k
categories, grid points, a bounded sample), not by the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions.columns import c, num
from gridscope.operators.aggregates import describe, group_sizes, to_long
from gridscope.operators.order import quantile_columns, quantiles
from gridscope.operators.relations import pearson_pairs, scatter_fit, strongest_pair

# Label of the pie slice that sums the categories beyond the top 10
OTHERS_LABEL = "Outros"


def auto_bins(n: int) -> int:
    """Bins used by the chart module: clamp(sqrt(n), 10, 50)."""
    return min(50, max(10, int(n ** 0.5)))


def histogram(df: DataFrame, col: str, bins: int | None = None, by: str | None = None) -> DataFrame:
    """K1: equal-width bins between the min and the max (per ``by`` group when
    given); the max falls in the last bin.  ``(by?, bin, lower, upper, count)``."""
    x = num(df, col)
    keys = [c(by).alias("group")] if by else []
    base = df.select(*keys, x.alias("x")).filter(F.col("x").isNotNull())
    gk = ["group"] if by else []
    rng = base.groupBy(*gk).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    if bins is None:
        nb = F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sqrt(F.col("n"))).cast("int")))
    else:
        nb = F.lit(int(bins))
    rng = rng.withColumn("bins", nb)
    # one range row per group: Catalyst/AQE broadcast it when it is small (no
    # hint: the number of groups is not bounded here)
    j = base.join(rng, gk, "inner") if gk else base.crossJoin(F.broadcast(rng))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width * F.col("bins")), F.col("bins") - 1)).cast("int")
    counts = j.withColumn("bin", b).groupBy(*gk, "bin", "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("count"))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return counts.select(*gk, "bin", (F.col("lo") + step * F.col("bin")).alias("lower"),
                         (F.col("lo") + step * (F.col("bin") + 1)).alias("upper"), "count")


def histogram_insights(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, std, pandas skew and 'normal' when |skew| < 0.5."""
    x = df.select(num(df, col).alias("x")).filter(F.col("x").isNotNull())
    n = F.count("x")
    st = x.agg(n.alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("g1"))
    med = quantiles(x, "x", [0.5]).select(F.col("q").alias("median"))
    g = F.when(F.col("n") >= 3, F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2))
    return st.crossJoin(med).select(F.lit(col).alias("column"), "mean", "median", "std", g.alias("skewness"),
                                    F.when(F.abs(g) < 0.5, "normal").otherwise("skewed").alias("distribution_type"))


def box_stats(df: DataFrame, col: str, by: str | None = None, top: int = 10) -> DataFrame:
    """K2: quartiles, whiskers (the most extreme values inside the 1.5 IQR
    fences), outlier count and %; grouped by the ``top`` most frequent
    categories when ``by`` is given, with the highest-median flag."""
    x = num(df, col)
    if by:
        cats = (df.filter(c(by).isNotNull()).groupBy(c(by).alias("group")).count()
                .orderBy(F.desc("count"), F.asc("group")).limit(top).select("group"))
        base = df.select(c(by).alias("group"), x.alias("x")).filter(F.col("x").isNotNull()).join(
            F.broadcast(cats), "group", "left_semi")
        gk = ["group"]
    else:
        base = df.select(x.alias("x")).filter(F.col("x").isNotNull())
        gk = []
    qs = quantile_columns(base, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=gk)
    fences = qs.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = base.join(F.broadcast(fences), gk) if gk else base.crossJoin(F.broadcast(fences))
    inside = (F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi"))
    agg = j.groupBy(*gk, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers_count"))
    out = agg.withColumn("outliers_percentage", F.col("outliers_count") / F.col("n") * 100)
    if by:
        best = out.agg(F.min_by("group", F.struct(F.negative("median"), F.col("group"))).alias("_best"))
        out = out.crossJoin(F.broadcast(best)).withColumn("highest_median", F.col("group") == F.col("_best")).drop("_best")
    return out


def bar(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """K5: the ``top`` most frequent values; total categories, and balance
    ('equilibrada' when the sample std of the shown counts < their mean)."""
    every = df.groupBy(c(col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    total = every.agg(F.count(F.lit(1)).alias("total_categories"))  # a null category counts
    vc = every.filter(F.col("category").isNotNull())
    top_rows = vc.orderBy(F.desc("count"), "category").limit(top)
    bal = top_rows.agg(F.when(F.stddev_samp("count") < F.avg("count"), "equilibrada")
                       .otherwise("desbalanceada").alias("distribution_balance"))
    return top_rows.crossJoin(total).crossJoin(bal)


def bar_values(df: DataFrame, x: str, y: str, color: str | None = None, top: int = 20) -> DataFrame:
    """K5 with a value column: the bar heights a value chart stacks per x (and
    per colour), i.e. the sum of ``y`` per group, for the ``top`` x values with
    the largest totals.  The output is bounded by ``top`` x colours."""
    keys = [c(x).cast("string").alias("x")] + ([c(color).cast("string").alias("color")] if color else [])
    sums = df.groupBy(*keys).agg(F.sum(num(df, y)).alias("y"))
    best = (sums.groupBy("x").agg(F.sum("y").alias("_t")).orderBy(F.desc("_t"), "x").limit(top).select("x"))
    return sums.join(F.broadcast(best), "x", "left_semi")


def line_insights(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """K4 annotations: number of points, first and last time (G10) and the
    slope of the values over their time order (G2)."""
    from gridscope.operators.timeseries import index_trend
    rng = df.filter(c(x).isNotNull() & num(df, y).isNotNull()).agg(
        F.count(F.lit(1)).alias("points"), F.min(c(x)).alias("start"), F.max(c(x)).alias("end"))
    return rng.crossJoin(index_trend(df, x, tie, y).select("slope", "trend"))


def pie(df: DataFrame, col: str, top: int = 10) -> DataFrame:
    """K6: top ``top`` slices plus 'Outros' with the rest (when there are more
    categories), each slice's percentage and the largest slice's share."""
    vc = df.filter(c(col).isNotNull()).groupBy(c(col).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("count"))
    ranked = _rank_small(vc, top)
    head = ranked.filter(F.col("_r") <= top)
    rest = ranked.filter(F.col("_r") > top).agg(F.sum("count").alias("count")).filter(F.col("count") > 0).select(
        F.lit(OTHERS_LABEL).alias("category"), "count", F.lit(top + 1).alias("_r"))
    slices = head.unionByName(rest)
    tot = slices.agg(F.sum("count").alias("_t"))
    return slices.crossJoin(tot).select("category", "count", (F.col("count") / F.col("_t") * 100).alias("percentage"),
                                        (F.col("_r") == 1).alias("largest"))


def _rank_small(vc: DataFrame, top: int) -> DataFrame:
    """Rank of each category by (count desc, value asc), computed without a
    single-partition window: the top rows are found by a bounded sort, the
    rest get rank top + 1."""
    head = vc.orderBy(F.desc("count"), "category").limit(top)
    head = head.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("count"), "category")))  # <= top rows
    return vc.join(F.broadcast(head.select("category", "_r")), "category", "left").fillna(top + 1, ["_r"])


def numeric_columns(df: DataFrame, most: int) -> list[str]:
    """The default of charts over several columns: the first ``most`` numeric ones."""
    from gridscope.operators.clean import select_by_type
    return select_by_type(df, "number").columns[:most]


def correlation_heatmap(df: DataFrame, cols: list[str] | None = None, default_cols: int = 10) -> tuple[DataFrame, DataFrame]:
    """K8: pairwise correlations of all given columns (of the first 10 numeric
    ones when none is given) rounded to 2 decimals, and the strongest positive /
    negative pair (F9)."""
    cols = cols or numeric_columns(df, default_cols)
    pairs = pearson_pairs(df, cols)
    return pairs.withColumn("corr", F.round("corr", 2)), strongest_pair(pairs)


def density(df: DataFrame, col: str, grid: int = 500, fine_bins: int = 4096) -> DataFrame:
    """K9: Gaussian kernel density on ``grid`` points between min and max
    with Scott's bandwidth (n^-1/5 x sample std).  The data are first binned
    into ``fine_bins`` equal-width bins (one aggregate); the kernel is then
    summed over bins x grid points - a broadcast nested-loop join whose size
    is fixed by the two constants, not by the data."""
    spark = df.sparkSession
    x = df.select(num(df, col).alias("x")).filter(F.col("x").isNotNull())
    st = x.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
               F.stddev_samp("x").alias("sd")).first()
    n, lo, hi, sd = st["n"], st["lo"], st["hi"], st["sd"]
    if not n or not sd or hi == lo:
        return spark.createDataFrame([], "x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    w = (hi - lo) / fine_bins
    binned = x.select(F.least(F.floor((F.col("x") - lo) / w), F.lit(fine_bins - 1)).cast("int").alias("b")).groupBy(
        "b").count().select((F.lit(lo) + (F.col("b") + 0.5) * w).alias("centre"), "count")
    pts = spark.range(grid).select((F.lit(lo) + F.col("id") * ((hi - lo) / (grid - 1))).alias("x"))
    k = F.exp(-0.5 * ((F.col("x") - F.col("centre")) / bw) ** 2) / (bw * math.sqrt(2 * math.pi))
    return pts.crossJoin(F.broadcast(binned)).groupBy("x").agg((F.sum(F.col("count") * k) / n).alias("density"))


def violin(df: DataFrame, col: str, by: str, top: int = 10, grid: int = 200, fine_bins: int = 1024) -> DataFrame:
    """K9 by category: a binned Gaussian density per category (Scott's
    bandwidth per category) on a per-category grid, for the ``top`` most
    frequent categories.  Per-category ranges are one aggregate (at most
    ``top`` rows, broadcast); bins are one grouped count; the kernel sum is
    bounded by top x bins x grid."""
    cats = (df.filter(c(by).isNotNull()).groupBy(c(by).alias("group")).count()
            .orderBy(F.desc("count"), F.asc("group")).limit(top).select("group"))
    x = df.select(c(by).alias("group"), num(df, col).alias("x")).filter(F.col("x").isNotNull()).join(
        F.broadcast(cats), "group", "left_semi")
    st = x.groupBy("group").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                F.stddev_samp("x").alias("sd")).filter((F.col("sd") > 0) & (F.col("hi") > F.col("lo")))
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n"), -0.2)).withColumn(
        "w", (F.col("hi") - F.col("lo")) / fine_bins)
    binned = (x.join(F.broadcast(st), "group")
              .select("group", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(fine_bins - 1))
                      .cast("int").alias("b"))
              .groupBy("group", "b").count())
    centres = binned.join(F.broadcast(st), "group").select(
        "group", (F.col("lo") + (F.col("b") + 0.5) * F.col("w")).alias("centre"), "count", "bw", "n")
    pts = st.select("group", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"), "lo", "hi").select(
        "group", (F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / (grid - 1))).alias("x"))
    k = F.exp(-0.5 * ((F.col("x") - F.col("centre")) / F.col("bw")) ** 2) / (F.col("bw") * math.sqrt(2 * math.pi))
    return pts.join(centres, "group").groupBy("group", "x").agg(
        (F.sum(F.col("count") * k) / F.first("n")).alias("density"))


def radar(df: DataFrame, cols: list[str] | None = None, default_cols: int = 6) -> DataFrame:
    """Means of all given columns (of the first 6 numeric ones when none is
    given), min-max normalized across the columns."""
    cols = cols or numeric_columns(df, default_cols)
    means = df.agg(*[F.avg(num(df, x)).alias(f"m{i}") for i, x in enumerate(cols)])
    long = means.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"m{i}").alias("mean"))
                                           for i, x in enumerate(cols)])))
    w = Window.partitionBy(F.lit(1))  # one row per column
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    return long.withColumn("normalized", F.try_divide(F.col("mean") - lo, hi - lo))


def statistical_summary(df: DataFrame, cols: list[str] | None = None, default_cols: int = 5) -> DataFrame:
    """describe() of all given columns (of the first 5 numeric ones when none
    is given), transposed to (statistic, column, value)."""
    d = describe(df, cols or numeric_columns(df, default_cols))
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return d.select("column", F.inline(F.array(*[
        F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in stats])))


def distribution_comparison(df: DataFrame, num: str, cat: str, top: int = 5, bins: int = 20) -> DataFrame:
    """20-bin histograms of ``num`` for the 5 most frequent categories."""
    cats = (df.filter(c(cat).isNotNull()).groupBy(c(cat).alias("_g")).count()
            .orderBy(F.desc("count"), F.asc("_g")).limit(top).select("_g"))
    sub = df.join(F.broadcast(cats), c(cat) == F.col("_g"), "left_semi")
    return histogram(sub, num, bins, by=cat)


def line_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """K4: every point with both values; the chart sorts by x (``orderBy``)."""
    from gridscope.functions.columns import utc_timestamp
    return df.select(utc_timestamp(df, x).alias("x"), num(df, y).alias("y")).dropna()


def line_buckets(df: DataFrame, x: str, y: str, buckets: int = 1000) -> DataFrame:
    """K4 for long series, an operator of its own: the mean of ``y`` in ``buckets``
    equal-width time buckets, at every size of the table."""
    from gridscope.functions.columns import epoch_micros
    base = df.select(epoch_micros(df, x).alias("_us"), num(df, y).alias("y")).dropna()
    st = base.agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")).first()
    if st["lo"] is None:
        return df.sparkSession.createDataFrame([], "x timestamp, y double, n long")
    width = (st["hi"] - st["lo"]) / buckets or 1.0
    b = F.least(F.floor((F.col("_us") - F.lit(st["lo"])) / F.lit(width)), F.lit(buckets - 1)).cast("long")
    agg = base.withColumn("_b", b).groupBy("_b").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.timestamp_micros((F.lit(st["lo"]) + F.col("_b") * F.lit(width)).cast("long")).alias("x"), "y", "n")


def scaled_rows(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """Every row, each column min-max scaled over the whole table."""
    st = df.agg(*[F.min(num(df, x)).alias(f"lo{i}") for i, x in enumerate(cols)],
                *[F.max(num(df, x)).alias(f"hi{i}") for i, x in enumerate(cols)]).first()
    out = [c(k) for k in keep]
    for i, x in enumerate(cols):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        width = (hi - lo) if hi is not None and hi != lo else 1.0
        out.append(((num(df, x) - F.lit(lo)) / F.lit(width)).alias(x))
    return df.select(*out)


def points(df: DataFrame, axes: dict[str, str], keep: dict[str, str] | None = None) -> DataFrame:
    """Every row with all ``axes`` (name -> numeric column) present, and the ``keep``
    columns (name -> any column) for colour, frame or label."""
    out = df.select(*[c(col).alias(name) for name, col in (keep or {}).items()],
                    *[num(df, col).alias(name) for name, col in axes.items()])
    return out.dropna(subset=list(axes))


def _marks(color: str | None, size: str | None) -> dict[str, str]:
    """The columns that colour and size the points, where given."""
    return {name: col for name, col in (("color", color), ("size", size)) if col}


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K3: all points (with colour and size columns) and the fit over them (F8)."""
    return points(df, {"x": x, "y": y}, _marks(color, size)), scatter_fit(df, x, y)


def scatter3d(df: DataFrame, x: str, y: str, z: str, color: str | None = None, size: str | None = None) -> DataFrame:
    """All points in three dimensions."""
    return points(df, {"x": x, "y": y, "z": z}, _marks(color, size))


def scatter_with_fit(df: DataFrame, *columns: str) -> DataFrame:
    """K3 as one dataset: every point (x, y and, when given, colour and size) with the
    correlation and the line of the one-row fit."""
    pts, fit = scatter(df, *columns[:4])
    return pts.crossJoin(F.broadcast(fit.select("correlation", "slope", "intercept", "show_line")))


def animated_scatter(df: DataFrame, x: str, y: str, frame: str) -> DataFrame:
    """All points with the frame they belong to."""
    return points(df, {"x": x, "y": y}, {"frame": frame})


def _as_json_rows(df: DataFrame) -> DataFrame:
    """A chart dataset, one JSON object a row."""
    return df.select(F.to_json(F.struct(*[c(x) for x in df.columns])).alias("data"))


def chart_data(df: DataFrame, chart_type: str, columns: list[str], key: str | None = None) -> DataFrame | None:
    """Dataset of one recommended chart (K1-K8, with the recommendation
    names that have no chart of their own mapped to the nearest one)."""
    from gridscope.operators.aggregates import crosstab
    t = chart_type
    if t in ("histogram",):
        return histogram(df, columns[0])
    if t in ("box_plot", "box"):
        return box_stats(df, columns[0])
    if t in ("grouped_box_plot",):
        return box_stats(df, columns[0], by=columns[1])
    if t in ("box_by_category",):
        return box_stats(df, columns[1], by=columns[0])
    if t in ("correlation_matrix", "correlation_heatmap"):
        return correlation_heatmap(df, columns)[0]
    if t in ("scatter_plot", "scatter"):
        return scatter_with_fit(df, *columns)
    if t in ("bar_chart", "bar"):
        return bar(df, columns[0])
    if t in ("pie_chart", "pie"):
        return pie(df, columns[0])
    if t in ("contingency_heatmap",):
        return crosstab(df, columns[0], columns[1])
    if t in ("time_series", "line"):
        return line_points(df, columns[0], columns[1])
    if t in ("violin",):
        return violin(df, columns[0], columns[1]) if len(columns) > 1 else density(df, columns[0])
    if t in ("density",):
        return density(df, columns[0])
    if t in ("scatter_points",):
        return points(df, {"x": columns[0], "y": columns[1]})
    if t in ("scatter_3d", "scatter3d"):
        return scatter3d(df, *columns[:5])
    if t in ("animated_scatter",):
        return animated_scatter(df, *columns[:3])
    if t in ("parallel_coordinates",):
        return scaled_rows(df, columns, [key] if key else [])
    if t in ("radar", "radar_chart"):
        return radar(df, columns)
    if t in ("treemap",):
        return group_sizes(df, columns[:1], with_parents=False)
    if t in ("sunburst",):
        return group_sizes(df, columns)
    if t in ("statistical_summary",):
        return statistical_summary(df, columns)
    if t in ("distribution_comparison",):
        return distribution_comparison(df, columns[0], columns[1])
    return None


def dashboard(df: DataFrame, recommendations: list[tuple[str, list[str]]], n: int = 6) -> DataFrame:
    """Datasets of the first ``n`` recommendations (6 for the dashboard,
    12 for "all charts"); recommendations whose columns are missing are
    skipped.  Long rows ``(chart_id, chart_type, columns, data)``, one per row of a
    chart's dataset (``data`` is that row as JSON), so no chart is gathered into
    one value."""
    spark = df.sparkSession
    out = None
    shown = 0
    for chart_type, cols in recommendations:
        if shown >= n:
            break
        if any(x not in df.columns for x in cols):
            continue
        data = chart_data(df, chart_type, cols)
        if data is None:
            continue
        part = _as_json_rows(data).select(F.lit(shown).alias("chart_id"), F.lit(chart_type).alias("chart_type"),
                                          F.array(*[F.lit(x) for x in cols]).alias("columns"), "data")
        out = part if out is None else out.unionByName(part)
        shown += 1
    if out is None:
        return spark.createDataFrame([], "chart_id int, chart_type string, columns array<string>, data string")
    return out
