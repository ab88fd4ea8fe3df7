"""Outliers and anomalies.

Bounds come from exact distributed quantiles (order.quantiles); flags are a
filter against those scalars, so each method is two or three jobs
regardless of the number of rows.  All columns are processed together in long
form ``(column, value)``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.columns import c, to_double
from gridscope.operators.aggregates import literal_map, to_long
from gridscope.operators.order import quantile_columns, quantiles


def _with_examples(out: DataFrame, flagged: DataFrame, k: int) -> DataFrame:
    """Attach up to ``k`` example values per column (none when ``k`` is 0:
    the flagged rows are then only counted)."""
    if k <= 0:
        return out.withColumn("outlier_values", F.lit(None).cast("array<double>"))
    return out.join(_examples(flagged, k), "column", "left")


def _examples(flagged: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` example values per column: the largest |z|-like distance
    first (deterministic; the reference lists them in file order)."""
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy(F.desc("_dist"), "value")
    salted = flagged.withColumn("_salt", F.abs(F.hash("value")) % 64)
    w1 = Window.partitionBy("column", "_salt").orderBy(F.desc("_dist"), "value")
    first = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    top = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct(F.negative("_dist").alias("d"),
                                                                            "value"))).alias("_ex")).select(
        "column", F.transform("_ex", lambda s: s["value"]).alias("outlier_values"))


def iqr_outliers(df: DataFrame, cols: list[str], min_rows: int = 10, k_examples: int = 10) -> DataFrame:
    """values outside [q1 - 1.5 IQR, q3 + 1.5 IQR]; columns with at
    least ``min_rows`` values: count, %, bounds and example values."""
    long = to_long(df, cols)
    qs = quantile_columns(long, "value", {"q1": 0.25, "q3": 0.75}, by=["column"])
    n = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    b = qs.join(n, "column").filter(F.col("n") >= min_rows).select(
        "column", "n", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    flagged = long.join(F.broadcast(b), "column").filter(
        (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))).withColumn(
        "_dist", F.greatest(F.col("lower_bound") - F.col("value"), F.col("value") - F.col("upper_bound")))
    cnt = flagged.groupBy("column").agg(F.count(F.lit(1)).alias("outlier_count"))
    out = b.join(cnt, "column", "left").fillna(0, ["outlier_count"])
    return _with_examples(out, flagged, k_examples).select(
        "column", "outlier_count", (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage"),
        "lower_bound", "upper_bound", "outlier_values")


def zscore_outliers(df: DataFrame, cols: list[str], threshold: float = 3.0, min_rows: int = 10,
                    k_examples: int = 10) -> DataFrame:
    """|x - mean| / population std > 3."""
    long = to_long(df, cols)
    st = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_m"),
                                    F.stddev_pop("value").alias("_s")).filter(F.col("n") >= min_rows)
    z = F.try_divide(F.abs(F.col("value") - F.col("_m")), F.col("_s"))
    flagged = long.join(F.broadcast(st), "column").filter((F.col("_s") > 0) & (z > threshold)).withColumn("_dist", z)
    cnt = flagged.groupBy("column").agg(F.count(F.lit(1)).alias("outlier_count"))
    out = st.join(cnt, "column", "left").fillna(0, ["outlier_count"])
    return _with_examples(out, flagged, k_examples).select(
        "column", "outlier_count", (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage"),
        F.lit(threshold).alias("threshold"), "outlier_values")


def modified_z_outliers(df: DataFrame, cols: list[str], threshold: float = 3.5, min_rows: int = 10,
                        k_examples: int = 10) -> DataFrame:
    """0.6745 |x - median| / MAD > 3.5; nothing is flagged when MAD = 0."""
    spark = df.sparkSession
    long = to_long(df, cols)
    med_rows = quantiles(long, "value", [0.5], by=["column"]).collect()  # one row per column
    medmap = literal_map(med_rows, "column", "q")
    dev = long.withColumn("_dev", F.abs(F.col("value") - medmap[F.col("column")]))
    mad = quantiles(dev, "_dev", [0.5], by=["column"]).select("column", F.col("q").alias("_mad"))
    med = spark.createDataFrame([(r["column"], r["q"]) for r in med_rows], "column string, _med double")
    n = long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    st = n.join(med, "column").join(mad, "column")
    mz = F.try_divide(0.6745 * F.col("_dev"), F.col("_mad"))
    flagged = dev.join(F.broadcast(st.select("column", "_mad")), "column").filter(
        (F.col("_mad") != 0) & (mz > threshold)).withColumn("_dist", mz)
    cnt = flagged.groupBy("column").agg(F.count(F.lit(1)).alias("outlier_count"))
    out = st.join(cnt, "column", "left").fillna(0, ["outlier_count"])
    return _with_examples(out, flagged, k_examples).select(
        "column", "outlier_count", (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage"),
        F.lit(threshold).alias("threshold"), "outlier_values")


def upper_outlier_share(df: DataFrame, cols: list[str], share: float = 5.0) -> DataFrame:
    """share of values above q3 + 1.5 IQR; ``flag`` when above ``share`` %."""
    long = to_long(df, cols)
    qs = quantile_columns(long, "value", {"q1": 0.25, "q3": 0.75}, by=["column"])
    hi = qs.select("column", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    agg = long.join(F.broadcast(hi), "column").groupBy("column", "upper_bound").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("upper_bound")).alias("above"))
    pct = F.col("above") / F.col("n") * 100
    return agg.select("column", "upper_bound", "n", "above", pct.alias("percentage"), (pct > share).alias("flag"))


# ---------------------------------------------------------------- isolation forest

def _c_factor(n: float) -> float:
    """Average path length of an unsuccessful search in a binary search tree."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _fit_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list:
    """One isolation tree on a 1-D sample, as a flat list of
    (split, left, right, size) nodes; leaves have split = NaN."""
    nodes: list = []

    def grow(vals, depth):
        idx = len(nodes)
        nodes.append(None)
        lo, hi = (vals.min(), vals.max()) if len(vals) else (0.0, 0.0)
        if depth >= max_depth or len(vals) <= 1 or lo == hi:
            nodes[idx] = (np.nan, -1, -1, len(vals))
            return idx
        s = rng.uniform(lo, hi)
        left = grow(vals[vals < s], depth + 1)
        right = grow(vals[vals >= s], depth + 1)
        nodes[idx] = (s, left, right, len(vals))
        return idx

    grow(x, 0)
    return nodes


def _path_lengths(nodes: list, x: np.ndarray) -> np.ndarray:
    """Path length of every value, all values moved one level at a time."""
    arr = np.asarray(nodes, dtype=float)
    split, left, right, size = arr[:, 0], arr[:, 1].astype(int), arr[:, 2].astype(int), arr[:, 3]
    node = np.zeros(len(x), dtype=int)
    depth = np.zeros(len(x))
    while True:
        s = split[node]
        inner = ~np.isnan(s)
        if not inner.any():
            break
        nxt = np.where(x < s, left[node], right[node])
        node = np.where(inner, nxt, node)
        depth += inner
    cf = np.array([_c_factor(v) for v in size])
    return depth + cf[node]


#: Occurrences of one value that one task draws from.
OCCURRENCES = 100_000


TREE_SCHEMA = "column string, tree int, n_sample long, nodes array<array<double>>"
STEP_SCHEMA = "column string, step int, lower_bound double, score double"
NO_OUTLIERS = "column string, outlier_count long, outlier_percentage double, outlier_values array<double>"


def isolation_trees(counts: DataFrame, sizes: dict[str, int], n_trees: int = 100, sample_size: int = 256,
                    seed: int = 42) -> DataFrame:
    """(column, tree, n_sample, nodes): ``n_trees`` isolation trees per column of the
    value counts (column, value, cnt), each grown on at most ``sample_size`` values.

    Every tree draws an independent Bernoulli sample of about 3 x ``sample_size``
    occurrences, then keeps the first ``sample_size`` in hash order.  Occurrences are
    first thinned to the union of the trees' samples, so the explode per tree
    touches about n_trees^2 x 768 rows whatever the column's size.  Draws depend on the
    column, the value and its how-manieth occurrence only, so the same table gives the
    same forest whatever its partitioning; frequent values are dealt out in stretches
    of occurrences."""
    from pyspark.sql import Window
    frac = {x: min(1.0, 3.0 * sample_size / max(1, sizes[x])) for x in sizes}
    pre = {x: min(1.0, n_trees * f) for x, f in frac.items()}
    frac_expr, pre_expr = (F.create_map(*[v for x, f in m.items() for v in (F.lit(x), F.lit(f))]) for m in (frac, pre))
    share = lambda *k: F.pmod(F.xxhash64(*k, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    stretch = counts.select("column", "value", "cnt", F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("cnt"), F.lit(OCCURRENCES))).alias("_from"))
    stretch = stretch.repartition("column", "value", "_from")
    each = stretch.select("column", "value", F.explode(F.sequence(
        F.col("_from"), F.least(F.col("cnt"), F.col("_from") + F.lit(OCCURRENCES - 1)))).alias("_k"))
    thinned = each.filter(share("column", "value", "_k") < pre_expr[F.col("column")])
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    cand = thinned.select("column", "value", "_k", trees).filter(
        share("column", "value", "_k", "tree") < frac_expr[F.col("column")] / pre_expr[F.col("column")])
    w = Window.partitionBy("column", "tree").orderBy(F.xxhash64("value", "_k", "tree", F.lit(seed + 1)), "value", "_k")
    samp = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample_size).drop("_r", "_k")
    max_depth = int(np.ceil(np.log2(max(sample_size, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        col, tree = pdf["column"].iloc[0], int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree, zlib.crc32(col.encode())])
        nodes = _fit_tree(pdf["value"].to_numpy(dtype=float), rng, max_depth)
        return pd.DataFrame({"column": [col], "tree": [tree], "n_sample": [len(pdf)],
                             "nodes": [[list(map(float, nd)) for nd in nodes]]})

    return samp.groupBy("column", "tree").applyInPandas(fit, TREE_SCHEMA)


def tree_scores(trees: pd.DataFrame, values: np.ndarray) -> np.ndarray:
    """Isolation score of ``values`` by walking every tree of one column."""
    trees = trees.sort_values("tree")
    depth = np.mean([_path_lengths([tuple(nd) for nd in nodes], values) for nodes in trees["nodes"]], axis=0)
    return 2.0 ** (-depth / _c_factor(float(np.mean(trees["n_sample"]))))


def isolation_steps(trees: DataFrame) -> DataFrame:
    """(column, step, lower_bound, score): the forest of each column as the step
    function it is in one dimension.  Its steps begin at the split values of all
    trees (a value equal to a split goes right), step 0 lies below the smallest; the
    trees are walked once per step, at most n_trees x (sample_size - 1) + 1 a column."""
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        splits = np.unique([nd[0] for nodes in pdf["nodes"] for nd in nodes if not np.isnan(nd[0])])
        score = tree_scores(pdf, np.concatenate([[-np.inf], splits]))
        return pd.DataFrame({"column": pdf["column"].iloc[0], "step": np.arange(len(score), dtype="int32"),
                             "lower_bound": np.concatenate([[np.nan], splits]), "score": score})

    out = trees.groupBy("column").applyInPandas(steps, STEP_SCHEMA)
    return out.withColumn("lower_bound", F.nanvl("lower_bound", F.lit(None).cast("double")))


def isolation_scores(counts: DataFrame, steps: DataFrame) -> DataFrame:
    """(column, value, cnt, score): every distinct value by binary search among the
    steps of its column, which are broadcast (their number is bounded, see
    ``isolation_steps``)."""
    found = steps.orderBy("column", "step").toPandas()
    model = {col: (g["lower_bound"].to_numpy(dtype=float)[1:], g["score"].to_numpy(dtype=float))
             for col, g in found.groupby("column")}
    bc = counts.sparkSession.sparkContext.broadcast(model)

    def look(it):
        for pdf in it:
            score = np.empty(len(pdf))
            for col, at in pdf.groupby("column").indices.items():
                bounds, scores = bc.value[col]
                score[at] = scores[np.searchsorted(bounds, pdf["value"].to_numpy(dtype=float)[at], side="right")]
            yield pdf.assign(score=score)

    return counts.mapInPandas(look, "column string, value double, cnt long, score double")


def isolation_forest(df: DataFrame, cols: list[str], contamination: float = 0.1, n_trees: int = 100,
                     sample_size: int = 256, seed: int = 42, min_rows: int = 10, k_examples: int = 5) -> DataFrame:
    """per column, flag the ``contamination`` share of values with the
    highest isolation score.

    One shuffle over rows counts the distinct values, which are stored; the trees
    are grown from them (``isolation_trees``), merged into one step table a column
    (``isolation_steps``) and each distinct value is looked up there once.  As a
    column has no more scores than steps, the exact (1 - contamination) quantile and
    the counts come from one small (column, score) table."""
    from gridscope.session import materialize
    from pyspark.sql import Window
    spark = df.sparkSession
    counts = materialize(to_long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")), "ivalues")
    n = counts.groupBy("column").agg(F.sum("cnt").alias("n")).filter(F.col("n") >= min_rows)
    sizes = {r["column"]: r["n"] for r in n.collect()}
    if not sizes:
        return spark.createDataFrame([], NO_OUTLIERS)
    counts = counts.filter(F.col("column").isin(list(sizes)))
    trees = isolation_trees(counts, sizes, n_trees, sample_size, seed)
    scored = materialize(isolation_scores(counts, isolation_steps(trees)), "iforest")
    per = scored.groupBy("column", "score").agg(F.sum("cnt").alias("cnt"))
    each = Window.partitionBy("column")
    at = (F.col("n") - 1) * (1 - contamination)
    run = per.select("column", "score", "cnt", F.sum("cnt").over(each.orderBy("score")).alias("cum"), F.sum("cnt").over(each).alias("n"))
    ends = run.groupBy("column", "n").agg(
        F.min(F.when(F.col("cum") > F.floor(at), F.col("score"))).alias("a"),
        F.min(F.when(F.col("cum") > F.least(F.floor(at) + 1, F.col("n") - 1), F.col("score"))).alias("b"))
    cut = ends.select("column", "n", (F.col("a") + (at - F.floor(at)) * (F.col("b") - F.col("a"))).alias("_cut"))
    above = per.join(F.broadcast(cut.drop("n")), "column").filter(F.col("score") > F.col("_cut"))
    out = cut.select("column", "n").join(
        above.groupBy("column").agg(F.sum("cnt").alias("outlier_count")), "column", "left").fillna(0, ["outlier_count"])
    flagged = scored.join(F.broadcast(cut.drop("n")), "column").filter(F.col("score") > F.col("_cut")).select(
        "column", "value", F.col("score").alias("_dist"),
        F.explode(F.array_repeat(F.lit(1), F.least("cnt", F.lit(k_examples)).cast("int"))))
    return _with_examples(out, flagged, k_examples).select(
        "column", "outlier_count", (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage"),
        "outlier_values")
