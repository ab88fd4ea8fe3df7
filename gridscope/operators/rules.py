"""Insights and recommendations (J1-J9) as joins and filters over the small
per-column result tables (types, quality, statistics, relationships).

Inputs have one row per column (or per column pair), so these plans are
tiny; they stay DataFrames so a whole analysis remains one lazy plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSIGHT_COLS = ["type", "category", "title", "description", "importance", "recommendation", "affected_columns", "ord"]

# Titles, sentences and advice texts of the insights (as the reference words them)
TXT = {
    "missing_title": "Dados Faltantes Detectados",
    "missing_rec": "Considere estratégias de imputação ou remoção de dados faltantes.",
    "lowq_title": "Colunas com Qualidade Baixa",
    "lowq_rec": "Revise e limpe os dados dessas colunas.",
    "skew_title": "Distribuição Enviesada em ",
    "skew_rec": "Considere transformações logarítmicas ou outras técnicas de normalização.",
    "out_title": "Muitos Outliers em ",
    "out_rec": "Investigue os outliers para determinar se são válidos ou erros.",
    "corr_title": "Correlação Forte Detectada",
    "corr_rec": "Investigue se existe causalidade ou se uma variável pode predizer a outra.",
    "dep_title": "Dependência Funcional Encontrada",
    "dep_rec": "Considere usar esta relação para validação de dados ou criação de chaves.",
    "anom_title": "Anomalias em ",
    "anom_rec": "Analise estes valores anômalos para entender se representam erros ou eventos especiais.",
    "nonnormal_title": "Distribuição Não-Normal em ",
    "nonnormal_rec": "Considere transformações (log, sqrt) ou métodos não-paramétricos.",
    "stat_corr_rec": "Investigate possível causalidade ou multicolinearidade.",
    "stat_out_rec": "Analise se outliers são erros ou valores legítimos extremos.",
    "cluster_title": "Estrutura de Grupos Detectada",
    "missing_text": 'Encontrados valores faltantes em %d colunas. A coluna "%s" tem %d valores faltantes (%.1f%% dos dados).',
    "skew_text": 'A coluna "%s" apresenta forte assimetria para a %s (skewness = %.2f).',
    "corr_text": 'As variáveis "%s" e "%s" apresentam correlação %s (%.3f).',
    "dep_text": 'A coluna "%s" determina completamente "%s", indicando uma relação funcional entre elas.',
    "anom_text": 'Detectadas %d anomalias na coluna "%s" (%.1f%% dos dados).',
    "stat_corr_text": 'Correlação %s (%.3f) entre "%s" e "%s".',
    "stat_out_text": 'A variável "%s" contém %.1f%% outliers (método IQR).',
    "out_text": 'A coluna "%s" contém %d outliers (%.1f%% dos dados), que podem indicar problemas '
                'de qualidade ou eventos excepcionais.',
    "nonnormal_text": 'A variável "%s" não segue distribuição normal. Apenas %d de %d testes de normalidade '
                      'foram aprovados.',
    "lowq_text": " apresentam problemas de qualidade como muitos valores duplicados ou formatos inconsistentes.",
    "cluster_text": "Os dados podem ser agrupados em %d clusters distintos.",
    "cluster_rec": "Analise as características de cada grupo para insights de segmentação.",
}


def materialize_small(df: DataFrame) -> DataFrame:
    """Re-create a per-column metadata table (a handful of rows) as a local
    relation, so the many small rule branches do not each recompute the
    aggregates that produced it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _insight(df: DataFrame, typ: str, cat: str, title, desc, imp: float, rec: str, affected, ord_col) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(F.lit(typ).alias("type"), F.lit(cat).alias("category"), lit(title).alias("title"),
                     lit(desc).alias("description"), F.lit(float(imp)).alias("importance"),
                     F.lit(rec).alias("recommendation"), affected.cast("array<string>").alias("affected_columns"),
                     ord_col.cast("int").alias("ord"))


def quality_insights(nulls: DataFrame, quality: DataFrame, rows: int) -> DataFrame:
    """J1.  ``nulls``: (column, nulls, ord); ``quality``: (column, quality_score, ord).
    Missing data (0.8): columns with NULLs, worst first (NULLs desc, then
    column order).  Low quality (0.7): columns scoring below 0.7."""
    miss = nulls.filter(F.col("nulls") > 0)
    agg = miss.agg(F.count(F.lit(1)).alias("k"),
                   F.sort_array(F.collect_list(F.struct(F.negative("nulls").alias("n"), F.col("ord"), F.col("column")))).alias("l"))
    agg = agg.filter(F.col("k") > 0)
    worst = F.col("l")[0]
    desc = F.format_string(TXT["missing_text"],
                           F.col("k"), worst["column"], -worst["n"], -worst["n"] / F.lit(rows) * 100)
    a = _insight(agg, "data_quality", "missing_data", TXT["missing_title"], desc, 0.8, TXT["missing_rec"],
                 F.transform("l", lambda s: s["column"]), F.lit(0))
    low = quality.filter(F.col("quality_score") < 0.7).agg(
        F.sort_array(F.collect_list(F.struct("ord", "column"))).alias("l")).filter(F.size("l") > 0)
    names = F.transform("l", lambda s: s["column"])
    d2 = F.concat(F.lit("As colunas "), F.array_join(names, ", "),
                  F.lit(TXT["lowq_text"]))
    b = _insight(low, "data_quality", "low_quality", TXT["lowq_title"], d2, 0.7, TXT["lowq_rec"], names, F.lit(1))
    return a.unionByName(b)


def distribution_insights(stats: DataFrame, rows: int) -> DataFrame:
    """J2.  ``stats``: (column, skewness, above_upper, ord) for numeric columns.
    |skew| > 2 (0.6); values above q3 + 1.5 IQR more than 5 % of all rows (0.7)."""
    sk = stats.filter(F.abs("skewness") > 2)
    direction = F.when(F.col("skewness") > 0, "direita").otherwise("esquerda")
    a = _insight(sk, "statistical", "distribution", F.concat(F.lit(TXT["skew_title"]), F.col("column")),
                 F.format_string(TXT["skew_text"],
                                 F.col("column"), direction, F.col("skewness")),
                 0.6, TXT["skew_rec"], F.array("column"), F.col("ord") * 2)
    ou = stats.filter(F.col("above_upper") > rows * 0.05)
    b = _insight(ou, "statistical", "outliers", F.concat(F.lit(TXT["out_title"]), F.col("column")),
                 F.format_string(TXT["out_text"], F.col("column"), F.col("above_upper"),
                                 F.col("above_upper") / F.lit(rows) * 100),
                 0.7, TXT["out_rec"], F.array("column"), F.col("ord") * 2 + 1)
    return a.unionByName(b)


def _position(cols: list[str]):
    return F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])


def rank_pairs(pairs: DataFrame, cols: list[str], value: str = "corr") -> DataFrame:
    """Rank column pairs by |r| descending; ties keep the column order in
    which the pairs were generated (a stable sort).  ``pairs`` has one row
    per column pair, so the window runs over a small table."""
    from pyspark.sql import Window
    pos = _position(cols)
    w = Window.orderBy(F.desc(F.abs(value)), pos[F.col("var1")], pos[F.col("var2")])
    return pairs.withColumn("rank", F.row_number().over(w))


def rank_dependencies(deps: DataFrame, cols: list[str]) -> DataFrame:
    """Rank dependencies in the order the reference finds them: determinant
    column order, then dependent column order (small table)."""
    from pyspark.sql import Window
    pos = _position(cols)
    w = Window.orderBy(pos[F.col("determinant")], pos[F.col("dependent")])
    return deps.withColumn("rank", F.row_number().over(w))


def relationship_insights(pairs: DataFrame, deps: DataFrame) -> DataFrame:
    """J3.  ``pairs``: sorted strong pairs (var1, var2, corr, strength, rank);
    the top one with |r| > 0.8 (0.9).  ``deps``: functional dependencies with
    a rank; the first one (0.8)."""
    top = pairs.filter(F.abs("corr") > 0.8).orderBy("rank").limit(1)
    a = _insight(top, "relationship", "correlation", TXT["corr_title"],
                 F.format_string(TXT["corr_text"],
                                 F.col("var1"), F.col("var2"), F.col("strength"), F.col("corr")),
                 0.9, TXT["corr_rec"], F.array("var1", "var2"), F.lit(0))
    d = deps.orderBy("rank").limit(1)
    b = _insight(d, "relationship", "dependency", TXT["dep_title"],
                 F.format_string(TXT["dep_text"],
                                 F.col("determinant"), F.col("dependent")),
                 0.8, TXT["dep_rec"], F.array("determinant", "dependent"), F.lit(1))
    return a.unionByName(b)


def anomaly_insights(anomalies: DataFrame) -> DataFrame:
    """J4.  ``anomalies``: (column, outlier_count, outlier_percentage, ord);
    one insight per column above 5 % (0.6)."""
    a = anomalies.filter(F.col("outlier_percentage") > 5)
    return _insight(a, "anomaly", "outliers", F.concat(F.lit(TXT["anom_title"]), F.col("column")),
                    F.format_string(TXT["anom_text"],
                                    F.col("outlier_count"), F.col("column"), F.col("outlier_percentage")),
                    0.6, TXT["anom_rec"], F.array("column"), F.col("ord"))


def rank_insights(*groups: DataFrame) -> DataFrame:
    """Union in generation order, then importance descending (stable)."""
    tagged = [g.withColumn("_grp", F.lit(i)) for i, g in enumerate(groups)]
    allg = reduce(lambda a, b: a.unionByName(b), tagged)
    return allg.orderBy(F.desc("importance"), "_grp", "ord").drop("_grp")


def statistical_insights(consensus: DataFrame, pairs: DataFrame, iqr: DataFrame, k: int | None) -> DataFrame:
    """Non-normal columns (0.7), the top strong correlation (0.9), IQR
    outliers above 5 % (0.8), a k-means structure with k > 1 (0.7)."""
    spark = consensus.sparkSession
    nn = consensus.filter(~F.col("likely_normal"))
    a = _insight(nn, "statistical", "normality", F.concat(F.lit(TXT["nonnormal_title"]), F.col("column")),
                 F.format_string(TXT["nonnormal_text"], F.col("column"), F.col("normal_tests_passed"), F.col("total_tests")),
                 0.7, TXT["nonnormal_rec"], F.array("column"), F.col("ord"))
    top = pairs.orderBy("rank").limit(1)
    b = _insight(top, "statistical", "correlation", TXT["corr_title"],
                 F.format_string(TXT["stat_corr_text"], F.col("strength"), F.col("corr"),
                                 F.col("var1"), F.col("var2")),
                 0.9, TXT["stat_corr_rec"], F.array("var1", "var2"), F.lit(0))
    o = iqr.filter(F.col("outlier_percentage") > 5)
    c = _insight(o, "statistical", "outliers", F.concat(F.lit(TXT["out_title"]), F.col("column")),
                 F.format_string(TXT["stat_out_text"], F.col("column"),
                                 F.col("outlier_percentage")),
                 0.8, TXT["stat_out_rec"], F.array("column"), F.col("ord"))
    parts = [a, b, c]
    if k is not None and k > 1:
        one = spark.range(1)
        parts.append(_insight(one, "statistical", "clustering", TXT["cluster_title"],
                              F.lit(TXT["cluster_text"] % k), 0.7,
                              TXT["cluster_rec"], F.array().cast("array<string>"), F.lit(0)))
    return reduce(lambda x, y: x.unionByName(y), parts)


# Recommendations (category, title, text, priority, actions), as the reference words them
STAT_RECS = {
    "outliers": ("data_quality", "Limpeza de Outliers", "Considere investigar e tratar outliers detectados.", "high",
                 ["Visualize outliers em gráficos", "Determine se são erros ou valores legítimos",
                  "Considere remoção ou transformação"]),
    "non_normal": ("modeling", "Uso de Métodos Não-Paramétricos", "Variáveis {0} não são normais.", "medium",
                   ["Use testes não-paramétricos (Mann-Whitney, Kruskal-Wallis)", "Considere transformações (log, Box-Cox)",
                    "Use algoritmos robustos a não-normalidade"]),
    "correlations": ("visualization", "Visualização de Relacionamentos",
                     "Crie visualizações para explorar correlações encontradas.", "medium",
                     ["Crie matriz de correlação heatmap", "Faça scatter plots das correlações fortes",
                      "Analise correlações parciais"]),
}


def statistical_recommendations(has_outliers: bool, non_normal: list[str], has_correlations: bool, spark) -> DataFrame:
    """Outlier clean-up (high), non-parametric methods (medium),
    relationship charts (medium) - each when its trigger holds - with what to do."""
    holds = {"outliers": has_outliers, "non_normal": bool(non_normal), "correlations": has_correlations}
    rows = [(c, t, d.replace("{0}", ", ".join(non_normal)), p, a) for k, (c, t, d, p, a) in STAT_RECS.items() if holds[k]]
    return spark.createDataFrame(rows, "category string, title string, description string, priority string, actions array<string>")


# A rule: chart, weight, kind of the first and the second column (None: one column),
# columns taken as a list (0: one rule hit per column or pair), most distinct values
# of the categorical column, numbers of numeric and categorical columns that the
# table must have (low, high), and texts with {0} and {1} for the columns.
MANY = 1_000_000
# Titles and descriptions, as the reference words them
CHART_RULES = [
    ("histogram", 0.9, "numeric", None, 0, MANY, (1, 1), (0, 0), "Distribuição de {0}",
     "Mostra a distribuição de frequência dos valores de {0}", '{"bins": {bins}}'),
    ("box_plot", 0.8, "numeric", None, 0, MANY, (1, 1), (0, 0), "Box Plot de {0}", "Identifica outliers e quartis de {0}", "{}"),
    ("correlation_matrix", 0.95, "numeric", None, MANY, MANY, (2, MANY), (0, 0), "Matriz de Correlação",
     "Mostra correlações entre variáveis numéricas", '{"method": "pearson"}'),
    ("scatter_plot", 0.7, "numeric", "numeric", 0, MANY, (2, MANY), (0, 0), "{0} vs {1}", "Relação entre {0} e {1}",
     '{"x": "{0}", "y": "{1}"}'),
    ("bar_chart", 0.9, "categorical", None, 0, MANY, (0, 0), (1, 1), "Distribuição de {0}", "Frequência das categorias em {0}", "{}"),
    ("pie_chart", 0.8, "categorical", None, 0, 8, (0, 0), (1, 1), "Proporção de {0}",
     "Proporção relativa das categorias em {0}", "{}"),
    ("contingency_heatmap", 0.85, "categorical", None, 2, MANY, (0, 0), (2, MANY), "Tabela de Contingência",
     "Mostra a relação entre categorias", "{}"),
    ("grouped_box_plot", 0.85, "numeric", "categorical", 0, 10, (1, MANY), (1, MANY), "{0} por {1}",
     "Distribuição de {0} em cada categoria de {1}", '{"x": "{1}", "y": "{0}"}'),
    ("time_series", 0.9, "date", "numeric", 0, MANY, (0, MANY), (0, MANY), "{1} ao longo do tempo",
     "Evolução temporal de {1}", '{"x": "{0}", "y": "{1}"}'),
]
# The same for the structural types; the weights are the priorities.
PRIORITIES = {3.0: "high", 2.0: "medium", 1.0: "low"}
_ANY = (0, MANY)
VISUAL_RULES = [
    ("histogram", 3.0, "numeric", None, 0, MANY, _ANY, _ANY, "", "", ""),
    ("box", 2.0, "numeric", None, 0, MANY, _ANY, _ANY, "", "", ""),
    ("bar", 3.0, "categorical", None, 0, 20, _ANY, _ANY, "", "", ""),
    ("pie", 2.0, "categorical", None, 0, 20, _ANY, _ANY, "", "", ""),
    ("line", 3.0, "datetime", "numeric", 0, MANY, _ANY, _ANY, "", "", ""),
    ("correlation_heatmap", 3.0, "numeric", None, MANY, MANY, (2, MANY), _ANY, "", "", ""),
    ("scatter", 2.0, "numeric", "numeric", 0, MANY, _ANY, _ANY, "", "", ""),
    ("box_by_category", 3.0, "categorical", "numeric", 0, 10, _ANY, _ANY, "", "", ""),
]
_RULE_SCHEMA = ("rule int, chart string, weight double, kind string, other string, take int, most int, "
                "num_lo int, num_hi int, cat_lo int, cat_hi int, title string, description string, config string")


def apply_rules(types: DataFrame, rules: list[tuple]) -> DataFrame:
    """Every hit of a rule table on ``(column, type, distinct, ord)``: the rules
    are joined to the columns by kind.  All tables here have one row per rule or
    column."""
    spark = types.sparkSession
    cols = materialize_small(types.select("column", "type", "distinct", "ord"))
    table = spark.createDataFrame([(i, *r[:6], *r[6], *r[7], *r[8:]) for i, r in enumerate(rules)], _RULE_SCHEMA)
    have = cols.agg(F.count_if(F.col("type") == "numeric").alias("n"), F.count_if(F.col("type") == "categorical").alias("k"))
    live = table.crossJoin(F.broadcast(have)).filter("n BETWEEN num_lo AND num_hi AND k BETWEEN cat_lo AND cat_hi").drop("n", "k")

    def side(tag):
        return F.broadcast(cols.select(F.col("column").alias(f"c{tag}"), F.col("type").alias(f"t{tag}"),
                                       F.col("distinct").alias(f"d{tag}"), F.col("ord").alias(f"o{tag}")))

    few = lambda t, d: (F.col(t) != "categorical") | (F.col(d) <= F.col("most"))
    hits = live.join(side(0), F.col("t0") == F.col("kind")).filter(few("t0", "d0"))
    lists = hits.filter("take > 0").groupBy(*table.columns).agg(F.sort_array(F.collect_list(F.struct("o0", "c0"))).alias("l"))
    lists = lists.filter(F.size("l") >= 2).select(
        *table.columns, F.slice(F.transform("l", lambda x: x["c0"]), 1, F.col("take")).alias("columns"), F.lit(0).alias("o0"), F.lit(0).alias("o1"),
        F.lit(None).cast("long").alias("d0"))
    single = hits.filter("take = 0 AND other IS NULL").select(*table.columns, F.array("c0").alias("columns"), "o0", F.lit(0).alias("o1"), "d0")
    pairs = hits.filter("take = 0").join(side(1), F.col("t1") == F.col("other")).filter(
        few("t1", "d1") & ((F.col("kind") != F.col("other")) | (F.col("o0") < F.col("o1"))))
    pairs = pairs.select(*table.columns, F.array("c0", "c1").alias("columns"), "o0", "o1", "d0")
    return lists.unionByName(single).unionByName(pairs)


def _ranked(hits: DataFrame, out) -> DataFrame:
    """Hits by weight, then rule, then column order, numbered from 0 (small table)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("weight"), "rule", "o0", "o1")
    return hits.withColumn("ord", F.row_number().over(w) - 1).select(*out, "ord")


def _filled(template: str):
    """A text of a rule with the column names put in."""
    first, second = F.get("columns", F.lit(0)), F.coalesce(F.get("columns", F.lit(1)), F.lit(""))
    text = F.replace(F.replace(F.col(template), F.lit("{0}"), first), F.lit("{1}"), second)
    bins = F.least(F.lit(30), F.coalesce(F.col("d0"), F.lit(0))).cast("string")
    return F.replace(text, F.lit("{bins}"), bins).alias(template)


def recommend_charts(types: DataFrame) -> DataFrame:
    """Chart recommendations from the semantic type table
    ``(column, type, distinct, ord)`` by ``CHART_RULES``: ``(chart_type, columns,
    relevance, title, description, config, ord)``, relevance descending."""
    out = [F.col("chart").alias("chart_type"), "columns", F.col("weight").alias("relevance"), _filled("title"), _filled("description"),
           _filled("config")]
    return _ranked(apply_rules(types, CHART_RULES), out)


def recommend_visualizations(types: DataFrame) -> DataFrame:
    """J9 from the structural types ``(column, type, distinct, ord)`` by
    ``VISUAL_RULES``: ``(type, columns, priority, grp, ord)``, high priority first."""
    names = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    out = [F.col("chart").alias("type"), "columns", names[F.col("weight")].alias("priority"), F.lit(0).alias("grp")]
    return _ranked(apply_rules(types, VISUAL_RULES), out)
