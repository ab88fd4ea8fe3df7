"""Score-table queries (entry point 1 on the driver tables).

The "sheet" is the order priority, the entity is the customer; a score is an
order's total price.  Orders are pre-aggregated per (customer, priority)
before the join with customer, so the join sees one row per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.operators import scores as S
from gridscope.plans.catalog import query, round_cols, t

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def customer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(Planilha, Escola, Media, Valores_Utilizados): mean order value per
    customer name within each order priority."""
    o = t(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.sum("o_totalprice").alias("_s"), F.count(F.lit(1)).alias("_n"))
    cu = t(spark, sf, "customer").select("c_custkey", "c_name")
    j = o.join(cu, o.o_custkey == cu.c_custkey, "inner")
    g = j.groupBy(F.col("o_orderpriority").alias(S.SHEET), F.col("c_name").alias(S.ENTITY)).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias(S.USED))
    return g.select(S.SHEET, S.ENTITY, (F.col("_s") / F.col(S.USED)).alias(S.MEAN), S.USED)


SCORES_SQL = """
WITH s AS (
  SELECT o.o_orderpriority AS Planilha, c.c_name AS Escola,
         avg(o.o_totalprice) AS m, count(*) AS Valores_Utilizados
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)
"""


@query("score_ranking", SCORES_SQL + """
SELECT Planilha, Escola, round(m, 4) AS Media, Valores_Utilizados,
       row_number() OVER (PARTITION BY Planilha ORDER BY m DESC, Escola) AS rank,
       CASE row_number() OVER (PARTITION BY Planilha ORDER BY m DESC, Escola)
            WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '📊' END AS medal
FROM s""")
def score_ranking(spark, sf):
    """Flagship: D14 -> E1."""
    return round_cols(S.rank_in_sheet(customer_scores(spark, sf)), 4)


@query("sheet_stats", SCORES_SQL + """
SELECT Planilha, count(*) AS escolas, round_even(avg(m), 2) AS media,
       round_even(min(m), 2) AS minimo, round_even(max(m), 2) AS maximo
FROM s GROUP BY Planilha""")
def sheet_stats(spark, sf):
    return S.sheet_stats(customer_scores(spark, sf))


@query("sheet_spread", SCORES_SQL + """
SELECT Planilha, round(avg(m), 4) AS sheet_mean, round(stddev_samp(m), 4) AS sheet_std,
       round(max(m) - min(m), 4) AS sheet_range, count(*) AS sheet_rows,
       (SELECT count(*) FROM s) AS total_rows,
       (SELECT count(DISTINCT Planilha) FROM s) AS total_sheets,
       (SELECT round(avg(m), 4) FROM s) AS overall_mean
FROM s GROUP BY Planilha""")
def sheet_spread(spark, sf):
    return round_cols(S.sheet_spread(customer_scores(spark, sf)), 4)


@query("comparison_matrix", SCORES_SQL + """
SELECT Escola,
  round(avg(m) FILTER (WHERE Planilha = '1-URGENT'), 4) AS "1-URGENT",
  round(avg(m) FILTER (WHERE Planilha = '2-HIGH'), 4) AS "2-HIGH",
  round(avg(m) FILTER (WHERE Planilha = '3-MEDIUM'), 4) AS "3-MEDIUM",
  round(avg(m) FILTER (WHERE Planilha = '4-NOT SPECIFIED'), 4) AS "4-NOT SPECIFIED",
  round(avg(m) FILTER (WHERE Planilha = '5-LOW'), 4) AS "5-LOW"
FROM s GROUP BY Escola""")
def comparison_matrix(spark, sf):
    return round_cols(S.comparison_matrix(customer_scores(spark, sf), PRIORITIES), 4)


def _order_sheet(spark, sf):
    """Orders ⋈ customer re-labelled as a score sheet: the customer name is the
    entity column, two score columns (one null for open orders) and one text
    column whose name has a score word but no number."""
    o = t(spark, sf, "orders")
    cu = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    j = o.join(cu, o.o_custkey == cu.c_custkey)
    return j.select(
        F.col("o_orderpriority").alias("sheet"),
        F.col("c_name").alias("nome_cliente"),
        (F.col("o_totalprice") / 1000).alias("nota_pedido"),
        F.when(F.col("o_orderstatus") == "F", F.col("c_acctbal") / 100).alias("media_saldo"),
        F.col("o_orderstatus").alias("resultado_status"),
        F.col("o_orderdate").alias("data"))


@query("row_scores", """
SELECT c.c_name AS Escola, o.o_orderpriority AS Planilha,
  round((o.o_totalprice / 1000 + coalesce(CASE WHEN o.o_orderstatus = 'F' THEN c.c_acctbal / 100 END, 0))
        / (1 + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS Media,
  CAST(1 + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS Valores_Utilizados
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def row_scores(spark, sf):
    """Entity column + keyword columns found from the names, row means."""
    sheet = _order_sheet(spark, sf)
    return round_cols(S.sheet_scores(sheet, sheet_col="sheet"), 6)


@query("entity_means", """
WITH r AS (
  SELECT c.c_name AS Escola, o.o_orderpriority AS Planilha, o.o_totalprice AS Valor
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT Planilha, Escola, round(avg(Valor), 4) AS Media, count(Valor) AS Valores_Utilizados
FROM r GROUP BY Planilha, Escola""")
def entity_means(spark, sf):
    """L6 over long records (Escola, Planilha, Valor)."""
    sheet = _order_sheet(spark, sf).select(
        F.col("nome_cliente").alias("Escola"), F.col("sheet").alias("Planilha"),
        (F.col("nota_pedido") * 1000).alias("Valor"))
    return round_cols(S.entity_means(sheet), 4)


@query("score_report", SCORES_SQL + """
, st AS (SELECT Planilha, avg(m) AS sm, stddev_samp(m) AS ss, max(m) - min(m) AS sr, count(*) AS sn FROM s GROUP BY 1)
SELECT s.Planilha, Escola, round(m, 4) AS Media, Valores_Utilizados,
  row_number() OVER (PARTITION BY s.Planilha ORDER BY m DESC, Escola) AS rank,
  CASE row_number() OVER (PARTITION BY s.Planilha ORDER BY m DESC, Escola)
       WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '📊' END AS medal,
  round(sm, 4) AS sheet_mean, round(ss, 4) AS sheet_std, round(sr, 4) AS sheet_range, sn AS sheet_rows,
  (SELECT count(*) FROM s) AS total_rows, (SELECT count(DISTINCT Planilha) FROM s) AS total_sheets,
  (SELECT round(avg(m), 4) FROM s) AS overall_mean
FROM s JOIN st ON s.Planilha = st.Planilha""")
def score_report(spark, sf):
    return round_cols(S.score_report(customer_scores(spark, sf)), 4)
