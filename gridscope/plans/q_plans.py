"""Queries over the analyses (P1-P4) and the cell-table path."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.operators import sheets as L
from gridscope.plans import analyses as P
from gridscope.plans.catalog import query, round_cols, t
from gridscope.sources.cells import table_to_cells


def order_cells(spark, sf):
    """Orders joined with customers as one score sheet per order priority,
    in cell form (rows in order-key order)."""
    o = t(spark, sf, "orders")
    cu = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    j = o.join(cu, o.o_custkey == cu.c_custkey).select(
        "o_orderpriority", "o_orderkey", F.col("c_name").alias("nome_cliente"),
        F.col("o_totalprice").alias("nota_pedido"),
        F.when(F.col("o_orderstatus") == "F", F.col("c_acctbal")).alias("media_saldo"),
        F.col("o_orderstatus").alias("resultado_status"))
    return table_to_cells(j, "o_orderpriority", ["o_orderkey"],
                          ["o_orderkey", "nome_cliente", "nota_pedido", "media_saldo", "resultado_status"])


@query("cell_scores", """
SELECT o.o_orderpriority AS Planilha, c.c_name AS Escola,
  round((o.o_totalprice + coalesce(CASE WHEN o.o_orderstatus = 'F' THEN c.c_acctbal END, 0))
        / (1 + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS Media,
  CAST(1 + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS Valores_Utilizados
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def cell_scores(spark, sf):
    """L7 + B18/B19 on the cell table: entity and score columns found per
    sheet from headers and cell contents; row means over score cells."""
    sc = L.cell_sheet_scores(order_cells(spark, sf))
    return round_cols(sc.drop("pos"), 6)


@query("cell_sheet_stats", """
WITH s AS (SELECT o.o_orderpriority AS Planilha,
  (o.o_totalprice + coalesce(CASE WHEN o.o_orderstatus = 'F' THEN c.c_acctbal END, 0))
        / (1 + CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS m
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT Planilha, count(*) AS escolas, round_even(avg(m), 2) AS media, round_even(min(m), 2) AS minimo,
  round_even(max(m), 2) AS maximo FROM s GROUP BY 1""")
def cell_sheet_stats(spark, sf):
    """P1 over the cell path: per-sheet statistics of the cell scores."""
    res = P.score_sheets(order_cells(spark, sf))
    return res["sheet_stats"]


@query("statistical_insights")
def statistical_insights(spark, sf):
    """P3 insights over part's numbers (rows-only: k-means and forest are seeded heuristics)."""
    res = P.comprehensive_statistics(t(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_type"])
    return res["insights"].select("type", "category", "title", "importance")


@query("smart_insights")
def smart_insights(spark, sf):
    """P2 ranked insights over the dirty events table (rows-only)."""
    from gridscope.plans.q_clean import dirty_events
    d = dirty_events(spark, sf).select("event_type", "value", "value_text", "user_text", "empty_col")
    res = P.smart_analysis(d, statistics=False)
    return res["insights"].select("type", "category", "title", "importance")


def _auto_structure_sql():
    from gridscope.plans.catalog import ORACLES
    # P4 drops wholly empty columns first (orders has none), then recommends
    # exactly as J9 does
    return "SELECT type, columns, priority FROM (" + ORACLES["visualization_recs"] + ")"


@query("auto_structure_recs", _auto_structure_sql())
def auto_structure_recs(spark, sf):
    """P4 visualization recommendations over orders."""
    res = P.auto_structure(t(spark, sf, "orders"))
    return res["recommendations"].select("type", F.array_join("columns", ",").alias("columns"), "priority")


# Header block of the hierarchical sheets built below (area / fortnight / metric rows)
HIER_HEADER = [
    (0, 1, "LÍNGUA PORTUGUESA"), (0, 3, "MATEMÁTICA"),
    (1, 1, "1ª QUINZENA"), (1, 3, "1ª QUINZENA"),
    (2, 0, "ESCOLA"), (2, 1, "ENGAJAMENTO"), (2, 2, "ACERTOS"), (2, 3, "ENGAJAMENTO"), (2, 4, "ACERTOS"),
]


def hierarchical_cells(spark, sf):
    """Orders laid out as hierarchical score sheets, one per order priority:
    four header rows (area, fortnight, metric, blank), then one row per
    customer with, for open orders (Língua Portuguesa) and finished orders
    (Matemática), the number of orders (engagement) and the largest order
    value written with a decimal comma (hits).  Headers are all 'Unnamed'."""
    from gridscope.operators.order import dense_position
    o = t(spark, sf, "orders")
    cu = t(spark, sf, "customer").select("c_custkey", "c_name")
    j = o.join(cu, o.o_custkey == cu.c_custkey)
    per = j.groupBy(F.col("o_orderpriority").alias("file"), F.col("c_name").alias("name")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("n_o"),
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("m_o"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("m_f"))
    pos = dense_position(per, ["name"], by=["file"], out="r")
    txt = lambda col: F.regexp_replace(col.cast("string"), r"\.", ",")
    body = pos.select("file", (F.col("r") + 4).cast("int").alias("pos"), F.inline(F.array(
        F.struct(F.lit(0).alias("col"), F.col("name").alias("value")),
        F.struct(F.lit(1).alias("col"), F.when(F.col("n_o") > 0, F.col("n_o").cast("string")).alias("value")),
        F.struct(F.lit(2).alias("col"), txt(F.col("m_o")).alias("value")),
        F.struct(F.lit(3).alias("col"), F.when(F.col("n_f") > 0, F.col("n_f").cast("string")).alias("value")),
        F.struct(F.lit(4).alias("col"), txt(F.col("m_f")).alias("value")))))
    sheets = per.select("file").distinct()
    grid = spark.createDataFrame([(p, cc) for p in range(4) for cc in range(5)], "pos int, col int")
    head = spark.createDataFrame(HIER_HEADER, "pos int, col int, value string")
    header = sheets.crossJoin(F.broadcast(grid.join(head, ["pos", "col"], "left")))  # 20 cells per sheet
    cells = header.unionByName(body.select("file", "pos", "col", "value"))
    return cells.select("file", F.col("file").alias("sheet"), F.lit(0).alias("sheet_index"), "pos", "col",
                        F.concat(F.lit("Unnamed: "), F.col("col")).alias("header"), "value")


HIER_RECORDS_SQL = """
WITH per AS (SELECT o_orderpriority AS Planilha, c_name AS Escola,
               count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m_o,
               count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m_f
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
rec AS (
  SELECT Planilha, Escola, 'Língua Portuguesa' AS Area, 'Engajamento' AS Metrica, CAST(n_o AS DOUBLE) AS Valor FROM per WHERE n_o > 0
  UNION ALL SELECT Planilha, Escola, 'Língua Portuguesa', 'Acertos', m_o FROM per WHERE m_o IS NOT NULL
  UNION ALL SELECT Planilha, Escola, 'Matemática', 'Engajamento', CAST(n_f AS DOUBLE) FROM per WHERE n_f > 0
  UNION ALL SELECT Planilha, Escola, 'Matemática', 'Acertos', m_f FROM per WHERE m_f IS NOT NULL)
"""


@query("hier_records", HIER_RECORDS_SQL + """
SELECT Planilha AS file, Escola, Area, '1ª QUINZENA' AS Periodo, Metrica, round(Valor, 2) AS Valor FROM rec""")
def hier_records(spark, sf):
    """Detect the hierarchical sheets, read their header rows, find
    the first data row and the entity column, and unpivot every metric cell."""
    from gridscope.session import materialize
    cells = materialize(hierarchical_cells(spark, sf), "cells")  # read by several sub-plans
    hierarchical, _ = L.split_by_kind(cells)
    rec = L.unpivot_scores(hierarchical)
    return round_cols(rec.select("file", "Escola", "Area", "Periodo", "Metrica", "Valor"), 2)


@query("hier_entity_means", HIER_RECORDS_SQL + """
SELECT Planilha, Escola, round(avg(Valor), 4) AS Media, count(*) AS Valores_Utilizados FROM rec GROUP BY 1, 2""")
def hier_entity_means(spark, sf):
    """L6 via P1: per-entity means of the hierarchical records."""
    res = P.score_sheets(hierarchical_cells(spark, sf))
    return round_cols(res["scores"], 4)


def _register_late_oracles():
    """Oracles that reuse SQL registered by earlier query modules."""
    from gridscope.plans.catalog import ORACLES
    from gridscope.plans.q_charts import _dashboard_sql
    ORACLES["dashboard"] = _dashboard_sql()


_register_late_oracles()
