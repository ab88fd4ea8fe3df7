"""Insight and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import rules as J
from gridscope.operators import semantic as C
from gridscope.plans.catalog import query, t
from gridscope.plans.q_clean import DIRTY_SQL, dirty_events
from gridscope.plans.q_types import ORDER_COLS, ORDER_TYPES, _semantic_sql, _structural_sql


def _with_ord(spark, types, cols):
    pos = spark.createDataFrame([(x, i) for i, x in enumerate(cols)], "column string, ord int")
    return types.join(pos, "column")


def _distincts(df, cols):
    row = df.agg(*[F.count_distinct(F.col(x)).alias(x) for x in cols]).first().asDict()
    return df.sparkSession.createDataFrame(list(row.items()), "column string, distinct long")


@query("chart_recommendations", "WITH st AS (" + _semantic_sql("orders", ORDER_COLS) + "),\n"
       "pos AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(ORDER_COLS)) + ") v(c, ord)),\n"
       "dc AS (" + " UNION ALL ".join(f"SELECT '{x}' AS c, count(DISTINCT {x}) AS d FROM orders" for x in ORDER_COLS) + "),\n"
       """ty AS (SELECT st."column" AS c, st.type, dc.d, pos.ord FROM st JOIN pos ON st."column" = pos.c JOIN dc ON dc.c = pos.c),
num AS (SELECT * FROM ty WHERE type = 'numeric'), cat AS (SELECT * FROM ty WHERE type = 'categorical'),
dat AS (SELECT * FROM ty WHERE type = 'date'),
k AS (SELECT (SELECT count(*) FROM num) AS nn, (SELECT count(*) FROM cat) AS nc),
r AS (
  SELECT 'histogram' AS chart_type, c AS columns, 0.9 AS relevance, ord * 10 AS o FROM num, k WHERE nn = 1 AND nc = 0
  UNION ALL SELECT 'box_plot', c, 0.8, ord * 10 + 1 FROM num, k WHERE nn = 1 AND nc = 0
  UNION ALL SELECT 'correlation_matrix', (SELECT string_agg(c, ',' ORDER BY ord) FROM num), 0.95, 0 FROM k WHERE nn > 1 AND nc = 0
  UNION ALL SELECT 'scatter_plot', a.c || ',' || b.c, 0.7, a.ord * 1000 + b.ord + 1 FROM num a JOIN num b ON a.ord < b.ord, k
            WHERE nn > 1 AND nc = 0
  UNION ALL SELECT 'bar_chart', c, 0.9, ord * 10 FROM cat, k WHERE nc = 1 AND nn = 0
  UNION ALL SELECT 'pie_chart', c, 0.8, ord * 10 + 1 FROM cat, k WHERE nc = 1 AND nn = 0 AND d <= 8
  UNION ALL SELECT 'contingency_heatmap', (SELECT string_agg(c, ',' ORDER BY ord) FROM (SELECT * FROM cat ORDER BY ord LIMIT 2)),
            0.85, 0 FROM k WHERE nc > 1 AND nn = 0
  UNION ALL SELECT 'grouped_box_plot', n.c || ',' || c.c, 0.85, n.ord * 1000 + c.ord FROM num n, cat c, k
            WHERE nn >= 1 AND nc >= 1 AND c.d <= 10
  UNION ALL SELECT 'time_series', d.c || ',' || n.c, 0.9, 10000000 + d.ord * 1000 + n.ord FROM dat d, num n)
SELECT chart_type, columns, CAST(relevance AS DOUBLE) AS relevance, row_number() OVER (ORDER BY relevance DESC, o) AS rank FROM r""")
def chart_recommendations(spark, sf):
    """J8 over the semantic types of ``orders``."""
    o = t(spark, sf, "orders")
    types = _with_ord(spark, C.semantic_types(o, ORDER_COLS), ORDER_COLS)
    rec = J.recommend_charts(types)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("relevance"), "ord")  # over the handful of recommendations
    return rec.select("chart_type", F.array_join("columns", ",").alias("columns"), "relevance",
                      F.row_number().over(w).cast("long").alias("rank"))


@query("visualization_recs", "WITH st AS (" + _structural_sql("orders", ORDER_TYPES) + "),\n"
       "pos AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(ORDER_COLS)) + ") v(c, ord)),\n"
       """ty AS (SELECT st."column" AS c, st.type, st.distinct AS d, pos.ord FROM st JOIN pos ON st."column" = pos.c),
num AS (SELECT * FROM ty WHERE type = 'numeric'), cat AS (SELECT * FROM ty WHERE type = 'categorical'),
dat AS (SELECT * FROM ty WHERE type = 'datetime'),
r AS (
  SELECT 'histogram' AS type, c AS columns, 'high' AS priority, 0 AS grp, ord * 2 AS o FROM num
  UNION ALL SELECT 'box', c, 'medium', 0, ord * 2 + 1 FROM num
  UNION ALL SELECT 'bar', c, 'high', 1, ord * 2 FROM cat WHERE d <= 20
  UNION ALL SELECT 'pie', c, 'medium', 1, ord * 2 + 1 FROM cat WHERE d <= 20
  UNION ALL SELECT 'line', d.c || ',' || n.c, 'high', 2, d.ord * 1000 + n.ord FROM dat d, num n
  UNION ALL SELECT 'correlation_heatmap', (SELECT string_agg(c, ',' ORDER BY ord) FROM num), 'high', 3, 0
            WHERE (SELECT count(*) FROM num) >= 2
  UNION ALL SELECT 'scatter', a.c || ',' || b.c, 'medium', 3, a.ord * 1000 + b.ord + 1 FROM num a JOIN num b ON a.ord < b.ord
  UNION ALL SELECT 'box_by_category', c.c || ',' || n.c, 'high', 4, c.ord * 1000 + n.ord FROM cat c, num n WHERE c.d <= 10)
SELECT type, columns, priority,
  row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, grp, o) AS rank FROM r""")
def visualization_recs(spark, sf):
    """J9 over the structural types of ``orders``."""
    o = t(spark, sf, "orders")
    types = _with_ord(spark, C.structural_types(o, ORDER_COLS), ORDER_COLS)
    rec = J.recommend_visualizations(types)
    from pyspark.sql import Window
    pr = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    w = Window.orderBy(F.desc(pr), "grp", "ord")  # over the handful of recommendations
    return rec.select("type", F.array_join("columns", ",").alias("columns"), "priority",
                      F.row_number().over(w).cast("long").alias("rank"))


QI_COLS = ["event_id", "event_type", "value", "value_text", "user_text", "empty_col"]


@query("quality_insights", DIRTY_SQL + """
, nl AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS c, {i} AS ord, count_if({x} IS NULL) AS n, "
                                  f"greatest(0.0, 1 - 0.5 * count_if({x} IS NULL) / count(*) - 0.3 * (count(*) - count(DISTINCT {x}) "
                                  f"- CASE WHEN count_if({x} IS NULL) > 0 THEN 1 ELSE 0 END) / count(*)) AS q FROM dirty"
                                  for i, x in enumerate(QI_COLS)) + """),
w AS (SELECT * FROM nl WHERE n > 0 ORDER BY n DESC, ord)
SELECT 'data_quality' AS type, 'missing_data' AS category, CAST(0.8 AS DOUBLE) AS importance,
  (SELECT string_agg(c, ',' ORDER BY n DESC, ord) FROM w) AS affected,
  printf('Encontrados valores faltantes em %d colunas. A coluna "%s" tem %d valores faltantes (%.1f%% dos dados).',
         (SELECT count(*) FROM w), (SELECT c FROM w LIMIT 1), (SELECT n FROM w LIMIT 1),
         (SELECT n FROM w LIMIT 1) / (SELECT count(*) FROM dirty) * 100) AS description
WHERE (SELECT count(*) FROM w) > 0
UNION ALL
SELECT 'data_quality', 'low_quality', 0.7, string_agg(c, ',' ORDER BY ord),
  'As colunas ' || string_agg(c, ', ' ORDER BY ord) || ' apresentam problemas de qualidade como muitos valores duplicados ou formatos inconsistentes.'
FROM nl WHERE q < 0.7 HAVING count(*) > 0""")
def quality_insights(spark, sf):
    """J1 over the dirty events table."""
    from gridscope.operators.semantic import quality_scores
    d = dirty_events(spark, sf).select(*QI_COLS)
    q = _with_ord(spark, quality_scores(d, QI_COLS), QI_COLS)
    rows = d.count()
    ins = J.quality_insights(q.select("column", "nulls", "ord"), q.select("column", "quality_score", "ord"), rows)
    return ins.select("type", "category", "importance", F.array_join("affected_columns", ",").alias("affected"),
                      "description")


from gridscope.operators import relations as R  # noqa: E402
from gridscope.plans.q_relations import DOC_NUM, DOC_NUM_SQL, doc_numbers  # noqa: E402


def _fd_sql(tbl, cols):
    parts = []
    k = 0
    for a in cols:
        for b in cols:
            if a == b:
                continue
            parts.append(f"SELECT {k} AS o, '{a}' AS determinant, '{b}' AS dependent FROM "
                         f"(SELECT {a}, count(DISTINCT {b}) AS nb FROM {tbl} WHERE {a} IS NOT NULL GROUP BY 1) "
                         f"HAVING count_if(nb <> 1) = 0")
            k += 1
    return " UNION ALL ".join(parts)


_DOC_PAIRS = [(a, b) for i, a in enumerate(DOC_NUM) for b in DOC_NUM[i + 1:]]


@query("relationship_insights", "WITH d AS " + DOC_NUM_SQL + ",\np AS (" + " UNION ALL ".join(
    f"SELECT {i} AS o, '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM d" for i, (a, b) in enumerate(_DOC_PAIRS))
    + "),\ntop AS (SELECT * FROM p WHERE abs(r) >= 0.7 AND abs(r) > 0.8 ORDER BY abs(r) DESC, o LIMIT 1),\n"
    "fd AS (" + _fd_sql("d", DOC_NUM) + """),
first_fd AS (SELECT * FROM fd ORDER BY o LIMIT 1)
SELECT 'relationship' AS type, 'correlation' AS category, CAST(0.9 AS DOUBLE) AS importance, var1 || ',' || var2 AS affected,
  printf('As variáveis "%s" e "%s" apresentam correlação %s (%.3f).', var1, var2,
         CASE WHEN abs(r) > 0.8 THEN 'strong' ELSE 'moderate' END, r) AS description FROM top
UNION ALL
SELECT 'relationship', 'dependency', CAST(0.8 AS DOUBLE), determinant || ',' || dependent,
  printf('A coluna "%s" determina completamente "%s", indicando uma relação funcional entre elas.', determinant, dependent)
FROM first_fd""")
def relationship_insights(spark, sf):
    """J3 over document sizes: the strongest correlation above 0.8 and the
    first functional dependency in column order."""
    d = doc_numbers(spark, sf)
    pairs = J.rank_pairs(R.strong_pairs(R.pearson_pairs(d, DOC_NUM), strong_label_at=0.8), DOC_NUM)
    deps = J.rank_dependencies(R.functional_dependencies(d, DOC_NUM), DOC_NUM)
    ins = J.relationship_insights(pairs, deps)
    return ins.select("type", "category", "importance", F.array_join("affected_columns", ",").alias("affected"),
                      "description")


DIST_COLS = ["doc_id", "n_chars"]


@query("distribution_insights", "WITH s AS (" + " UNION ALL ".join(f"""
SELECT '{x}' AS col, {i} AS ord, any_value(g1) AS g1, count(*) FILTER (WHERE {x} > hi) AS above, any_value(n) AS n
FROM documents, (SELECT avg(power({x} - mu, 3)) / power(avg(power({x} - mu, 2)), 1.5) AS g1 FROM
               (SELECT {x}, avg({x}) OVER () AS mu FROM documents WHERE {x} IS NOT NULL)),
             (SELECT quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS hi,
                     count(*) AS n FROM documents)""" for i, x in enumerate(DIST_COLS)) + """)
SELECT 'statistical' AS type, 'distribution' AS category, CAST(0.6 AS DOUBLE) AS importance, col AS affected,
  printf('A coluna "%s" apresenta forte assimetria para a %s (skewness = %.2f).', col,
         CASE WHEN g1 > 0 THEN 'direita' ELSE 'esquerda' END, g1) AS description FROM s WHERE abs(g1) > 2
UNION ALL
SELECT 'statistical', 'outliers', CAST(0.7 AS DOUBLE), col,
  printf('A coluna "%s" contém %d outliers (%.1f%% dos dados), que podem indicar problemas de qualidade ou eventos excepcionais.',
         col, above, above / n * 100) FROM s WHERE above > n * 0.05""")
def distribution_insights(spark, sf):
    """J2 over document ids and sizes: strong skew and many upper outliers."""
    from gridscope.operators import outliers as O
    e = t(spark, sf, "documents")
    rows = e.count()
    skew = C.numeric_candidates(e, DIST_COLS, rows, with_median=False).select("column", "skewness")
    up = O.upper_outlier_share(e, DIST_COLS).select("column", F.col("above").alias("above_upper"))
    stats = _with_ord(spark, skew.join(up, "column"), DIST_COLS)
    ins = J.distribution_insights(stats, rows)
    return ins.select("type", "category", "importance", F.array_join("affected_columns", ",").alias("affected"),
                      "description")
