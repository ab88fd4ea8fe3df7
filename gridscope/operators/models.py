"""Multivariate models (H1-H6).

K-means runs in MLlib on a standardized vector column that is written once.  PCA and the
regressions all come from one centred cross-product aggregate (k(k+1)/2
sums): a k x k matrix is the only thing the driver holds, whatever the row
count.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.columns import c, num
from gridscope.operators.timeseries import durbin_watson_in_order
from gridscope.session import materialize


def centred_cross_products(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and centred cross-products with mean imputation (a missing value
    contributes 0 after centring, exactly as filling it with the mean)."""
    nd = df.select(*[num(df, x).alias(x) for x in cols])
    m = nd.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c(x)).alias(x) for x in cols]).first()
    n = m["_n"]
    means = np.array([m[x] if m[x] is not None else 0.0 for x in cols])
    cen = nd.select(*[F.coalesce(c(x) - F.lit(float(means[i])), F.lit(0.0)).alias(x) for i, x in enumerate(cols)])
    idx = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = cen.agg(*[F.sum(c(cols[i]) * c(cols[j])).alias(f"s{i}_{j}") for i, j in idx]).first()
    S = np.zeros((len(cols), len(cols)))
    for i, j in idx:
        S[i, j] = S[j, i] = row[f"s{i}_{j}"] or 0.0
    return means, S, n


def standardized_vectors(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Mean-imputed, population-std-scaled features assembled into ``features``."""
    keep = list(keep or [])
    nd = df.select(*[c(k) for k in keep], *[num(df, x).alias(x) for x in cols])
    st = nd.agg(*[F.avg(c(x)).alias(f"m{i}") for i, x in enumerate(cols)],
                 *[F.stddev_pop(c(x)).alias(f"s{i}") for i, x in enumerate(cols)]).first()
    scaled = nd.select(*[c(k) for k in keep], *[c(x) for x in cols], *[
        ((F.coalesce(c(x), F.lit(st[f"m{i}"])) - F.lit(st[f"m{i}"])) /
         F.lit(st[f"s{i}"] if st[f"s{i}"] else 1.0)).alias(f"_z{i}") for i, x in enumerate(cols)])
    va = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(cols))], outputCol="features")
    return va.transform(scaled).drop(*[f"_z{i}" for i in range(len(cols))])


def elbow_k(vectors: DataFrame, n_rows: int, seed: int = 42, k_max: int = 10) -> tuple[int, list[tuple[int, float]]]:
    """H2: fit k = 2..min(10, n // 2) and return the k *before* the largest
    drop in inertia (the reference's rule) and the (k, inertia) list."""
    top = min(k_max, n_rows // 2)
    if top < 2:
        return 2, []
    inertias = []
    for k in range(2, top + 1):
        m = KMeans(k=k, seed=seed, featuresCol="features").fit(vectors)
        inertias.append((k, float(m.summary.trainingCost)))
    if len(inertias) < 2:
        return 2, inertias
    drops = [inertias[i - 1][1] - inertias[i][1] for i in range(1, len(inertias))]
    return inertias[int(np.argmax(drops))][0], inertias


def kmeans(df: DataFrame, cols: list[str], k: int | None = None, seed: int = 42, min_rows: int = 10):
    """H1 + H3: standardized k-means (k from the elbow rule when not given).

    Returns ``(labelled rows, centres table, summary table, inertia, k)``;
    the summary has size, %, mean and sample std of every column per cluster
    on the unscaled values."""
    spark = df.sparkSession
    vec = materialize(standardized_vectors(df, cols), "vectors")
    n = vec.count()
    if len(cols) < 2 or n < min_rows:
        raise ValueError("k-means needs at least 2 numeric columns and 10 rows")
    curve = []
    if k is None:
        k, curve = elbow_k(vec, n, seed)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vec)
    labelled = model.transform(vec).drop("features")
    centres = spark.createDataFrame(
        [(i, [float(v) for v in ctr]) for i, ctr in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    summary = cluster_summary(labelled, cols, n)
    return labelled, centres, summary, float(model.summary.trainingCost), k, curve


def cluster_summary(labelled: DataFrame, cols: list[str], n: int, label: str = "cluster") -> DataFrame:
    """Per cluster size, %, and per-column mean / std (long form)."""
    long = labelled.select(label, F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), c(x).cast("double").alias("value")) for x in cols])))
    per = long.groupBy(label, "column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                            F.min("value").alias("min"), F.max("value").alias("max"))
    size = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return per.join(size, label).withColumn("percentage", F.col("size") / F.lit(n) * 100)


def pca(df: DataFrame, cols: list[str], min_rows: int = 10, n_vectors: int = 3) -> DataFrame:
    """H4: PCA of the standardized (mean-imputed) columns: explained ratio,
    cumulative ratio, components for 90 %, reduction potential (p - c) / p
    and the first three component vectors (sign fixed so the largest |entry|
    is positive).  Eigen-decomposition of the k x k correlation matrix."""
    spark = df.sparkSession
    schema = ("component int, explained_variance_ratio double, cumulative_variance double, "
              "components_for_90_percent int, dimensionality_reduction_potential double, loadings array<double>")
    if len(cols) < 3:
        return spark.createDataFrame([], schema)
    _, S, n = centred_cross_products(df, cols)
    if n < min_rows:
        return spark.createDataFrame([], schema)
    d = np.sqrt(np.diag(S))
    d[d == 0] = 1.0
    R = S / np.outer(d, d)
    vals, vecs = np.linalg.eigh(R)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    ratio = vals / vals.sum()
    cum = np.cumsum(ratio)
    c90 = int(np.argmax(cum >= 0.90 - 1e-12) + 1)
    rows = []
    for i in range(len(cols)):
        v = vecs[:, i]
        if v[np.argmax(np.abs(v))] < 0:
            v = -v
        rows.append((i + 1, float(ratio[i]), float(cum[i]), c90, float((len(cols) - c90) / len(cols)),
                     [float(x) for x in v] if i < n_vectors else None))
    return spark.createDataFrame(rows, schema)


def regress_each(df: DataFrame, cols: list[str], min_rows: int = 10) -> DataFrame:
    """H5: every column regressed on all the others (mean-imputed): r²,
    intercept, coefficients, residual mean and sample std.  One cross-product
    aggregate serves every target."""
    spark = df.sparkSession
    schema = ("target string, predictors array<string>, coefficients array<double>, intercept double, "
              "r_squared double, residual_mean double, residual_std double, n long, error string, "
              "means map<string,double>")
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    means, S, n = centred_cross_products(df, cols)
    rows = []
    for t_i, tgt in enumerate(cols):
        pred = [j for j in range(len(cols)) if j != t_i]
        if n < min_rows:
            continue
        Sxx = S[np.ix_(pred, pred)]
        Sxy = S[pred, t_i]
        try:
            beta = np.linalg.solve(Sxx, Sxy)
        except np.linalg.LinAlgError:
            beta = np.linalg.lstsq(Sxx, Sxy, rcond=None)[0]
        sst = S[t_i, t_i]
        sse = max(0.0, sst - float(beta @ Sxy))
        r2 = 1 - sse / sst if sst > 0 else float("nan")
        intercept = float(means[t_i] - beta @ means[pred])
        rows.append((tgt, [cols[j] for j in pred], [float(b) for b in beta], intercept, float(r2), 0.0,
                     math.sqrt(sse / (n - 1)) if n > 1 else None, n, None,
                     {x: float(means[j]) for j, x in enumerate(cols)}))
    return spark.createDataFrame(rows, schema)


def residuals(df: DataFrame, target: str, predictors: list[str], coefficients: list[float], intercept: float,
              keep: list[str], means: dict | None = None) -> DataFrame:
    """Residuals y - (b0 + b x) with the coefficients as literals (mean-imputed
    x; pass the fit's ``means`` to skip the aggregate that finds them)."""
    if means is None:
        means = df.agg(*[F.avg(num(df, x)).alias(x) for x in predictors + [target]]).first().asDict()
    fit = F.lit(intercept)
    for x, b in zip(predictors, coefficients):
        fit = fit + F.lit(b) * F.coalesce(num(df, x), F.lit(means[x]))
    y = F.coalesce(num(df, target), F.lit(means[target]))
    return df.select(*[c(k) for k in keep], (y - fit).alias("resid"))


def durbin_watson(df: DataFrame, resid: str, order: list[str]) -> DataFrame:
    """H6: sum (e_t - e_{t-1})^2 / sum e_t^2 in the given row order."""
    return durbin_watson_in_order(df.select(*[c(o) for o in order], c(resid)), order, resid)
