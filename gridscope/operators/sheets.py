"""Score sheets in cell form (L1-L7 with B18/B19 on cells).

Input: the cell table ``(file, sheet, pos, col, header, value)`` of
``sources.cells``.  Every step groups or windows by (file, sheet) - plus the
row or the column inside it - so no step looks at more than one sheet at a
time and all sheets run in the same job.

What is found out about a sheet (its kind, first data row, entity column, the
metric of a column) is a small table of one row per sheet or column.  It meets
the sheet's rows by sheet and block of ``BLOCK`` positions, so a long sheet is
dealt over many tasks; written first, it has a known size, and Spark sends it to
every task while that is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions.columns import parse_percent, text_to_double
from gridscope.operators.scores import ENTITY, ENTITY_WORDS, MEAN, SCORE_WORDS, SHEET, USED
from gridscope.session import materialize

SHEET_KEY = ["file", "sheet"]

# Positions of a sheet that one join key may hold
BLOCK = 1 << 15

# Words that mark a hierarchical (area / fortnight / metric) score sheet
HIER_WORDS = ["LÍNGUA", "PORTUGUESA", "MATEMÁTICA", "QUINZENA", "ENGAJAMENTO", "ACERTOS"]
# area, period and metric markers of the header rows, and the defaults
AREA_PT, AREA_MAT = "Língua Portuguesa", "Matemática"
METRIC_ENG, METRIC_ACE = "Engajamento", "Acertos"
DEFAULT_AREA, DEFAULT_PERIOD = "Geral", "Período"

_ALPHA = r"\p{L}"
_DIGIT = r"\p{Nd}"


def _txt():
    return F.trim(F.coalesce(F.col("value"), F.lit("")))


def _block(pos):
    return F.floor(F.coalesce(pos, F.lit(0)) / BLOCK)


def _extent() -> list:
    """Aggregates: first and last block of the rows grouped."""
    return [F.min(_block(F.col("pos"))).alias("_from"), F.max(_block(F.col("pos"))).alias("_to")]


def _meet(rows: DataFrame, facts: DataFrame, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows (with ``pos``) joined with a table of facts per sheet (and column, by
    ``on``) that names the sheet's blocks ``_from`` to ``_to``."""
    spread = facts.withColumn("_block", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    return rows.withColumn("_block", _block(F.col("pos"))).join(spread, [*SHEET_KEY, *(on or []), "_block"], how).drop("_block")


def _kinds(cells: DataFrame, min_words: int = 2) -> DataFrame:
    low = F.lower(F.coalesce(F.col("value"), F.lit("")))
    head = cells.filter(F.col("pos") < 6)
    hits = [F.max(F.when(low.contains(w.lower()), 1).otherwise(0)) for w in HIER_WORDS]
    kw = head.groupBy(*SHEET_KEY).agg(sum(hits, F.lit(0)).alias("keywords"))
    hd = cells.groupBy(*SHEET_KEY).agg(F.bool_and(F.col("header").startswith("Unnamed")).alias("all_unnamed"), *_extent())
    return hd.join(kw, SHEET_KEY, "left").fillna(0, ["keywords"]).withColumn(
        "hierarchical", F.col("all_unnamed") & (F.col("keywords") >= min_words))


def is_hierarchical(cells: DataFrame, min_words: int = 2) -> DataFrame:
    """L1: per sheet, all headers start with 'Unnamed' and at least 2 of the
    6 keywords occur in the first 6 rows (case-insensitive)."""
    return _kinds(cells, min_words).drop("_from", "_to")


def split_by_kind(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of the hierarchical sheets and those of the others (L1)."""
    kind = materialize(_kinds(cells).select(*SHEET_KEY, "hierarchical", "_from", "_to"), "kinds")
    of = lambda k: _meet(cells, kind.filter(k).drop("hierarchical"), how="left_semi")
    return of(F.col("hierarchical")), of(~F.col("hierarchical"))


def column_hierarchy(cells: DataFrame, header_rows: int = 4) -> DataFrame:
    """L2: area / period / metric per column from the first 4 rows; area and
    period are carried to the right over columns that have none (the window
    runs over one sheet's columns), the metric is not."""
    h = cells.filter(F.col("pos") < header_rows).withColumn("_t", _txt()).withColumn("_l", F.lower(_txt()))
    area = F.when(F.col("_l").contains("língua p") | F.col("_l").contains("portuguesa"), AREA_PT).when(
        F.col("_l").contains("matemática"), AREA_MAT)
    period = F.when(F.col("_l").contains("quinzena"), F.col("_t"))
    metric = F.when(F.col("_l").contains("engajamento"), METRIC_ENG).when(F.col("_l").contains("acerto"), METRIC_ACE)
    per_col = h.groupBy(*SHEET_KEY, "col").agg(
        F.max_by(area, F.when(area.isNotNull(), F.col("pos"))).alias("_a"),
        F.max_by(period, F.when(period.isNotNull(), F.col("pos"))).alias("_p"),
        F.max_by(metric, F.when(metric.isNotNull(), F.col("pos"))).alias("metric"))
    w = Window.partitionBy(*SHEET_KEY).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return per_col.select(*SHEET_KEY, "col", F.last("_a", ignorenulls=True).over(w).alias("area"),
                          F.last("_p", ignorenulls=True).over(w).alias("period"), "metric")


def _row_arrays(cells: DataFrame) -> DataFrame:
    """One row per (sheet, pos) with its cells as an array sorted by column."""
    return cells.groupBy(*SHEET_KEY, "pos").agg(
        F.sort_array(F.collect_list(F.struct("col", _txt().alias("v")))).alias("cells"))


def _name_like(v):
    return (F.length(v) >= 4) & v.rlike(_ALPHA) & ~F.lower(v).startswith("unnamed")


def data_start_row(cells: DataFrame, first: int = 4, rows: DataFrame | None = None) -> DataFrame:
    """L3: first row at or after ``first`` with a name-like cell (>= 4 chars,
    a letter, not 'unnamed') followed within 5 columns by a cell with a digit.
    ``rows`` are the cells by row, if they are there already."""
    rows = (_row_arrays(cells) if rows is None else rows).filter(F.col("pos") >= first)
    has = F.exists("cells", lambda a: _name_like(a["v"]) & F.exists(
        "cells", lambda b: (b["col"] > a["col"]) & (b["col"] <= a["col"] + 5) & b["v"].rlike(_DIGIT)))
    return rows.filter(has).groupBy(*SHEET_KEY).agg(F.min("pos").alias("start"))


def best_entity_column(cells: DataFrame, start: DataFrame, window: int = 40) -> DataFrame:
    """L4: the column with most name-like text cells (not a number once dots
    are removed) in the first 40 data rows; lowest index on ties."""
    near = start.select(*SHEET_KEY, "start", _block(F.col("start")).alias("_from"), _block(F.col("start") + window).alias("_to"))
    j = _meet(cells, near).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + window))
    v = _txt()
    score = F.when(_name_like_plain(v) & ~F.regexp_replace(v, r"\.", "").rlike(r"^\p{Nd}+$"), 1).otherwise(0)
    per = j.groupBy(*SHEET_KEY, "col").agg(F.sum(score).alias("score"))
    return per.groupBy(*SHEET_KEY).agg(F.min_by("col", F.struct(F.negative("score"), F.col("col"))).alias("entity_col"))


def _name_like_plain(v):
    return (F.length(v) >= 4) & v.rlike(_ALPHA)


def unpivot_scores(cells: DataFrame) -> DataFrame:
    """L2-L5 on hierarchical sheets: long records
    ``(file, sheet, pos, Escola, Area, Periodo, Metrica, Valor)``.

    Data rows run from the start row until the first row without an entity
    whose cells are more than 80 % empty; rows without an entity before that
    are skipped.  Every metric column gives a record with the percent-text
    parse; NULL values are dropped."""
    rows = materialize(_row_arrays(cells), "rows")
    start = materialize(data_start_row(cells, rows=rows), "starts")
    ent = best_entity_column(cells, start)
    size = rows.groupBy(*SHEET_KEY).agg(F.max(F.element_at("cells", -1)["col"] + 1).alias("n_cols"), *_extent())
    about = materialize(start.join(ent, SHEET_KEY).join(size, SHEET_KEY), "sheets")
    hier = materialize(column_hierarchy(cells).filter(F.col("metric").isNotNull()).join(
        about.select(*SHEET_KEY, "_from", "_to"), SHEET_KEY), "metrics")
    entity = F.array_max(F.transform(F.filter("cells", lambda a: a["col"] == F.col("entity_col")), lambda a: a["v"]))
    name = F.coalesce(F.col("_entity"), F.lit(""))
    no_entity = (name == "") | F.lower(name).startswith("unnamed")
    empty = F.size(F.filter("cells", lambda a: a["v"] == ""))
    stop = _meet(rows, about).filter(F.col("pos") >= F.col("start")).withColumn("_entity", entity).filter(
        no_entity & (empty / F.col("n_cols") > 0.8)).groupBy(*SHEET_KEY).agg(F.min("pos").alias("_stop"))
    until = materialize(about.join(stop, SHEET_KEY, "left"), "stops")
    keep = _meet(rows, until).filter(
        (F.col("pos") >= F.col("start")) & (F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))).withColumn(
        "_entity", entity).filter(~no_entity)
    each = keep.select(*SHEET_KEY, "pos", "_entity", "entity_col", F.inline("cells")).filter(F.col("col") != F.col("entity_col"))
    vals = _meet(each, hier, ["col"])
    return vals.select(*SHEET_KEY, "pos", F.col("_entity").alias("Escola"),
                       F.coalesce(F.when(F.col("area") != "", F.col("area")), F.lit(DEFAULT_AREA)).alias("Area"),
                       F.coalesce(F.when(F.col("period") != "", F.col("period")), F.lit(DEFAULT_PERIOD)).alias("Periodo"),
                       F.col("metric").alias("Metrica"), parse_percent(F.col("v")).alias("Valor")).filter(
        F.col("Valor").isNotNull())


def _roles(cells: DataFrame) -> DataFrame:
    low = F.lower("header")
    num = text_to_double(F.col("value"))
    per = cells.groupBy(*SHEET_KEY, "col", "header").agg(
        F.count_if(F.col("value").isNotNull() & num.isNull()).alias("_text"),
        F.count(num).alias("_nums"), *_extent())
    ent_word = F.lit(False)
    for w in ENTITY_WORDS:
        ent_word = ent_word | low.contains(w)
    score_word = F.lit(False)
    for w in SCORE_WORDS:
        score_word = score_word | low.contains(w)
    per = per.withColumn("is_text", F.col("_text") > 0).withColumn(
        "is_score", score_word & (F.col("_nums") > 0)).withColumn("_ent", F.col("is_text") & ent_word)
    first = F.struct(F.negative(F.col("_ent").cast("int")), F.col("col"))
    pick = per.groupBy(*SHEET_KEY).agg(F.min_by("col", F.when(F.col("is_text"), first)).alias("entity_col"),
                                       F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return per.drop("_from", "_to").join(pick, SHEET_KEY, "left").select(
        *SHEET_KEY, "col", "header", "is_text", "is_score", (F.col("col") == F.col("entity_col")).alias("is_entity"), "_from", "_to")


def cell_column_roles(cells: DataFrame) -> DataFrame:
    """B18 / B19 on cells: per (sheet, col) whether the column is text (holds
    a value that is not a number, like pandas' object dtype), whether it is the
    entity column, and whether it is a score column (score word in the header
    and at least one numeric value)."""
    return _roles(cells).drop("_from", "_to")


def cell_sheet_scores(cells: DataFrame) -> DataFrame:
    """L7 on cells: per entity row the mean and count of its parsable score
    cells; rows without an entity or without any score value are dropped.
    ``Planilha`` is the file name."""
    roles = materialize(_roles(cells).filter("is_score OR is_entity").select(
        *SHEET_KEY, "col", "is_score", "is_entity", "_from", "_to"), "roles")
    tagged = _meet(cells, roles, ["col"]).select(
        *SHEET_KEY, "pos", F.when(F.col("is_entity"), F.col("value")).alias("_e"),
        F.when(F.col("is_score"), text_to_double(F.col("value"))).alias("_x"))
    per_row = tagged.groupBy(*SHEET_KEY, "pos").agg(
        F.max("_e").alias(ENTITY), F.avg("_x").alias(MEAN), F.count("_x").alias(USED))
    return per_row.filter(F.col(ENTITY).isNotNull() & (F.col(USED) > 0)).select(
        F.col("file").alias(SHEET), ENTITY, MEAN, USED, "pos")


def score_sheets(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P1 core: hierarchical sheets go through L2-L6 (entity means over the
    long records), the others through L7; results are unioned.  Returns
    ``(scores, records)`` where records are the hierarchical long rows."""
    hcells, pcells = split_by_kind(cells)
    records = unpivot_scores(hcells)
    hmeans = records.groupBy(F.col("file").alias(SHEET), "Escola").agg(
        F.avg("Valor").alias(MEAN), F.count("Valor").alias(USED))
    plain = cell_sheet_scores(pcells).drop("pos")
    return plain.unionByName(hmeans), records


# Per-file processing messages of the score upload
MSG_HIER = "Arquivo %s (hierárquica) processado - %d escolas"
MSG_OK = "Arquivo %s processado com sucesso - %d escolas encontradas"
MSG_NO_COLUMNS = "Não foi possível identificar colunas válidas em %s"
MSG_NO_ROWS = "Nenhuma escola válida encontrada em %s"


def sheet_messages(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """One status row per file: hierarchical or plain, how many entities were
    scored, and the message the upload reports (no usable columns, no valid
    rows, or success)."""
    kind = is_hierarchical(cells).groupBy("file").agg(F.bool_or("hierarchical").alias("hierarchical"))
    roles = cell_column_roles(cells).groupBy("file").agg(
        F.bool_or("is_entity").alias("_has_entity"), F.bool_or("is_score").alias("_has_score"))
    n = scores.groupBy(F.col(SHEET).alias("file")).agg(F.count(F.lit(1)).alias("entities"))
    j = kind.join(roles, "file", "left").join(n, "file", "left").fillna(0, ["entities"])
    msg = (F.when(F.col("hierarchical") & (F.col("entities") > 0), F.format_string(MSG_HIER, "file", "entities"))
           .when(~F.coalesce(F.col("_has_entity"), F.lit(False)) | ~F.coalesce(F.col("_has_score"), F.lit(False)),
                 F.format_string(MSG_NO_COLUMNS, "file"))
           .when(F.col("entities") == 0, F.format_string(MSG_NO_ROWS, "file"))
           .otherwise(F.format_string(MSG_OK, "file", "entities")))
    return j.select("file", "hierarchical", "entities", msg.alias("message"))
