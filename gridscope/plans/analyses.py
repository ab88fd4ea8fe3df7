"""The analyses users call (P1-P4): compositions of the operators.

Each returns a dict of named result DataFrames.  The input is cached once
(``persist``) because every analysis scans it several times, and released at
the end; where a derived table feeds many later steps it is written once to
the folder named by ``spark.checkpoint.dir`` and read back
(``session.materialize``), which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.operators import aggregates as D
from gridscope.operators import clean as B
from gridscope.operators import outliers as O
from gridscope.operators import profile as P
from gridscope.operators import relations as R
from gridscope.operators import rules as J
from gridscope.operators import scores as S
from gridscope.operators import semantic as C
from gridscope.operators import sheets as L
from gridscope.operators import stattests as T
from gridscope.operators import timeseries as G
from gridscope.operators import models as H
from gridscope.session import materialize


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _ord_table(spark, cols):
    return spark.createDataFrame([(x, i) for i, x in enumerate(cols)], "column string, ord int")


def score_sheets(cells: DataFrame, first_sheet_only: bool = True) -> dict[str, DataFrame]:
    """Cell table of many sheets -> per-entity scores, the entity x sheet
    matrix, the engagement matrix of hierarchical sheets, per-sheet stats,
    rankings and the report table.  Like the upload route, a workbook
    contributes its first sheet (``first_sheet_only``).  The cell table and the
    scores feed several branches, so each is written once under the checkpoint
    folder, and the report takes the ranking as it is."""
    if first_sheet_only:
        cells = cells.filter(F.col("sheet_index") == 0)
    cells = materialize(cells, "cells")
    scores, records = L.score_sheets(cells)
    scores = materialize(scores, "scores")
    ranking = S.rank_in_sheet(scores)
    return {
        "scores": scores,
        "records": records,
        "comparison_matrix": S.comparison_matrix(scores),
        "engagement_matrix": S.engagement_matrix(records),
        "sheet_stats": S.sheet_stats(scores),
        "ranking": ranking,
        "report": S.score_report(scores, ranking),
        "messages": L.sheet_messages(cells, scores),
    }


def comprehensive_statistics(df: DataFrame, numeric: list[str], categorical: list[str] | None = None,
                             time_col: str | None = None, tie: str | None = None, trend_cols: int = 3,
                             series_cols: int = 2, tested_cols: int = 2, tested_categories: int = 1) -> dict[str, DataFrame]:
    """Descriptive statistics, normality, correlations, outliers, trends,
    time series, clustering, PCA, regressions and two-sample tests, plus the
    statistical insights and recommendations.

    Trends and seasonality look at the first ``trend_cols`` value columns, the
    series steps at ``series_cols``, the two-sample tests at ``tested_cols`` by
    ``tested_categories`` category columns: the reference's numbers, which a
    caller may raise.  The needed columns are written once to shared storage and
    read by every step."""
    spark = df.sparkSession
    categorical = categorical or []
    out: dict[str, DataFrame] = {}
    data = materialize(df.select(*[F.col(f"`{x}`") for x in dict.fromkeys([*numeric, *categorical, *filter(None, (time_col, tie))])]), "statistics")
    out["describe"] = D.describe(data, numeric)
    out["moments"] = D.moments(data, numeric)
    out["robust_spread"] = D.robust_spread(data, numeric)
    out["mode"] = D.mode(data, numeric)
    if categorical:
        # with the ten most frequent values of each (frequency distribution)
        out["categorical"] = D.frequency_summary(data, categorical).join(
            D.top_values(D.long_value_counts(data, categorical), 10), "column", "left")
    norm = []
    for col in numeric:
        sw = T.shapiro_wilk(data, col)
        dp = T.dagostino_pearson(data, [col])
        ad = T.anderson_darling(data, col)
        ks = T.ks_normal(data, col)
        norm.append(T.normality_consensus([sw, dp, ad, ks], col))
    consensus = norm[0]
    for x in norm[1:]:
        consensus = consensus.unionByName(x)
    consensus = consensus.filter(F.col("total_tests") > 0)  # columns under 8 values are not tested
    out["normality"] = consensus
    if len(numeric) >= 2:
        out["pearson"] = R.pearson_pairs(data, numeric)
        out["spearman"] = R.spearman_pairs(data, numeric)
        out["kendall"] = R.kendall_pairs(data, numeric)
        out["partial"] = R.partial_correlations(data, numeric)
    out["iqr_outliers"] = O.iqr_outliers(data, numeric)
    out["z_outliers"] = O.zscore_outliers(data, numeric)
    out["modified_z_outliers"] = O.modified_z_outliers(data, numeric)
    out["isolation_forest"] = O.isolation_forest(data, numeric, k_examples=10)
    if time_col:
        out["trend"] = G.add_p_values(G.linear_trend(data, time_col, numeric[:trend_cols]))
        out["seasonality"] = _union([G.seasonal_strength(data, time_col, x) for x in numeric[:trend_cols]])
        out["series"] = G.series_summary(data, time_col, numeric[:series_cols])
        # frequency of the series itself: times where the first value is present
        out["frequency"] = G.series_frequency(data.filter(F.col(f"`{numeric[0]}`").isNotNull()), time_col)
        if tie:
            # the first value columns, as the reference's time-series step
            out["acf"] = _union([G.acf(data, time_col, tie, x).withColumn("column", F.lit(x)) for x in numeric[:series_cols]])
            out["pacf"] = _union([G.pacf(data, time_col, tie, x).withColumn("column", F.lit(x)) for x in numeric[:series_cols]])
            out["stationarity"] = _union([G.adf_test(data, time_col, tie, x) for x in numeric[:series_cols]])
    k = None
    if len(numeric) >= 2:
        labelled, centres, summary, inertia, k, _ = H.kmeans(data, numeric)
        out["clusters"] = summary
        out["cluster_centers"] = centres
        out["cluster_labels"] = labelled
        regs = H.regress_each(data, numeric)
        out["regressions"] = regs
        if time_col and tie:
            # Durbin-Watson of each regression's residuals in (time, tie) order
            dws = []
            for r in regs.collect():  # one row per numeric column
                res = H.residuals(data, r["target"], r["predictors"], r["coefficients"], r["intercept"],
                                  keep=[time_col, tie], means=r["means"])
                dws.append(H.durbin_watson(res, "resid", [time_col, tie]).select(
                    F.lit(r["target"]).alias("target"), "durbin_watson"))
            out["durbin_watson"] = dws[0]
            for d in dws[1:]:
                out["durbin_watson"] = out["durbin_watson"].unionByName(d)
    if len(numeric) >= 3:
        out["pca"] = H.pca(data, numeric)
    if categorical:
        tested = [(x, g) for g in categorical[:tested_categories] for x in numeric[:tested_cols]]
        out["t_test"] = _union([T.t_test(data, x, g) for x, g in tested])
        out["mann_whitney"] = _union([T.mann_whitney(data, x, g) for x, g in tested])
    ordc = _ord_table(spark, numeric)
    strong = (R.strong_pairs(out["pearson"]) if "pearson" in out
              else spark.createDataFrame([], "var1 string, var2 string, corr double, strength string"))
    strong = J.rank_pairs(strong, numeric)
    out["insights"] = J.statistical_insights(consensus.join(ordc, "column"), strong,
                                             out["iqr_outliers"].join(ordc, "column"), k)
    non_normal = [r["column"] for r in consensus.filter(~F.col("likely_normal")).collect()]
    out["recommendations"] = J.statistical_recommendations(bool(numeric), non_normal, "pearson" in out, spark)
    return out


def _time_column(df: DataFrame, types: DataFrame) -> str | None:
    """The first column of semantic type date that holds times, else the first column
    of a time type, else none."""
    times = [x for x, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz")]
    dates = {r["column"] for r in types.filter(F.col("type") == "date").select("column").collect()}
    return next((x for x in times if x in dates), next(iter(times), None))


def smart_analysis(df: DataFrame, statistics: bool = True) -> dict[str, DataFrame]:
    """Clean -> semantic types -> relationships -> chart recommendations
    -> ranked insights, and (unless ``statistics`` is off) the tables of
    ``comprehensive_statistics`` over the numeric and categorical columns under
    ``statistics:<name>``, with trends and series over the first date column."""
    spark = df.sparkSession
    cleaned, log = B.clean_table(df)
    cleaned = materialize(cleaned, "cleaned")  # later steps re-read it many times
    cols = cleaned.columns
    ordc = _ord_table(spark, cols)
    types = C.semantic_types(cleaned, cols).join(ordc, "column")
    rows = cleaned.count()
    numv = materialize(B.numeric_view(cleaned), "numeric")
    ncols = numv.columns
    pairs = R.strong_pairs(R.pearson_pairs(numv, ncols), strong_label_at=0.8) if len(ncols) >= 2 else None
    deps = R.functional_dependencies(cleaned, cols)
    anomalies = O.isolation_forest(numv, ncols).join(_ord_table(spark, ncols), "column")
    dep_rank = J.rank_dependencies(deps, cols)
    nums = [r["column"] for r in types.filter(F.col("type") == "numeric").collect()]
    num_stats = C.numeric_candidates(cleaned, nums, rows, with_median=False).select("column", "skewness") if nums else None
    up = O.upper_outlier_share(cleaned, nums).select("column", F.col("above").alias("above_upper")) if nums else None
    q = C.quality_scores(cleaned, cols).join(ordc, "column")
    groups = [J.quality_insights(q.select("column", "nulls", "ord"), q.select("column", "quality_score", "ord"), rows)]
    if nums:
        groups.append(J.distribution_insights(num_stats.join(up, "column").join(ordc, "column"), rows))
    if pairs is not None:
        pr = J.rank_pairs(pairs, ncols)
        groups.append(J.relationship_insights(pr, dep_rank))
    groups.append(J.anomaly_insights(anomalies))
    more = {}
    if statistics and nums:
        texts = [r["column"] for r in types.filter(F.col("type") == "categorical").collect()]
        time_col = _time_column(cleaned, types)
        # rows of one time are put in the order of their contents
        tie = "_contents" if time_col else None
        data = cleaned.withColumn(tie, F.xxhash64(*[F.col(f"`{x}`") for x in cols])) if tie else cleaned
        more = {f"statistics:{k}": v for k, v in comprehensive_statistics(data, nums, texts, time_col, tie).items()}
    return {
        **more,
        "cleaned": cleaned, "cleaning_log": log, "types": types,
        "correlations": pairs, "dependencies": deps, "similar_columns": R.similar_columns(numv, ncols),
        "anomalies": anomalies,
        "chart_recommendations": J.recommend_charts(types),
        "insights": J.rank_insights(*groups),
        "numeric_columns": spark.createDataFrame([(x,) for x in nums], "column string"),
    }


def auto_structure(df: DataFrame, preview_order: list[str] | None = None) -> dict[str, DataFrame]:
    """Drop empty columns -> column profiles, quality, summary, patterns,
    correlations, visualization recommendations (and a 10-row preview)."""
    from gridscope.sources.sinks import preview
    spark = df.sparkSession
    data = materialize(B.drop_empty_columns(df), "structure")
    cols = data.columns
    ordc = _ord_table(spark, cols)
    prof = P.column_profile(data)
    st = C.structural_types(data, cols).join(ordc, "column")
    nums = [r["column"] for r in st.filter(F.col("type") == "numeric").collect()]
    out = {
        "columns": prof,
        "data_quality": P.data_quality(data),
        "summary": P.summary_stats(data),
        "patterns": P.structure_patterns(data),
        "recommendations": J.recommend_visualizations(st),
    }
    if nums:
        typed = data.select(*[F.col(f"`{x}`") for x in cols])
        out["numeric"] = P.numeric_profile(typed, nums)
    # relationships use the physically numeric columns, as the structure
    # analysis does: strict |r| > 0.7 on the exact values, listed in column
    # order; the matrix itself is reported rounded to 3 decimals
    phys = B.select_by_type(data, "number").columns
    if len(phys) >= 2:
        pairs = R.pearson_pairs(data, phys)
        out["correlations"] = pairs.withColumn("corr", F.round("corr", 3))
        out["strong_correlations"] = R.strong_pairs(pairs, strict=True, strong_label_at=0.8, ordered=False)
    if preview_order:
        out["preview"] = preview(data, preview_order, 10)
    return out


def export_document(smart: dict[str, DataFrame], statistics: dict[str, DataFrame] | None = None) -> DataFrame:
    """The analysis as one JSON document of result groups - data info,
    cleaning log, column types, relationships, insights, chart
    recommendations and statistics.  Every group is a small result table
    (one row per column, pair, insight or chart), never the data rows."""
    from gridscope.sources.sinks import export_analysis
    cleaned = smart["cleaned"]
    info = cleaned.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(cleaned.columns)))
    groups = {
        "data_info": info,
        "cleaning_log": smart["cleaning_log"],
        "column_types": smart["types"],
        "relationships": smart["dependencies"],
        "insights": smart["insights"],
        "chart_recommendations": smart["chart_recommendations"],
    }
    if smart.get("correlations") is not None:
        groups["correlations"] = smart["correlations"]
    for name, data in (statistics or {}).items():
        if data is not None and name != "cluster_labels":  # that one has a row per data row
            groups["statistics" if name == "describe" else f"statistics_{name}"] = data
    return export_analysis(groups)
