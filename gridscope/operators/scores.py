"""Entity score tables: averages per entity over many sheets, rankings and
per-sheet statistics (B18, B19, L6, L7, D14, D16, D17, D20, D21, E1, A22).

A "sheet" is a value of the ``sheet`` column (``Planilha``), so thousands of
sheets are processed by one job; nothing is looped per sheet on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.columns import c, num
from gridscope.operators.aggregates import row_mean
from gridscope.operators.order import dense_position

# Fixed values (must equal the reference's vocabulary):
# words that mark the entity column, in the order they are tried
ENTITY_WORDS = ["escola", "unidade", "instituição", "nome"]
# words that mark a score column
SCORE_WORDS = ["alura", "bim", "média", "media", "nota", "avaliação", "resultado"]
# labels for the first three ranks, and for all others
MEDALS = ["🥇", "🥈", "🥉"]
OTHER_MEDAL = "📊"

ENTITY, SHEET, MEAN, USED = "Escola", "Planilha", "Media", "Valores_Utilizados"


def entity_column(df: DataFrame) -> str | None:
    """First text column whose name contains an entity word, else the first
    text column (B19).  Reads only the schema."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    for name in text:
        low = name.lower()
        if any(w in low for w in ENTITY_WORDS):
            return name
    return text[0] if text else None


def keyword_columns(df: DataFrame, words: list[str] = SCORE_WORDS) -> list[str]:
    """Columns whose lower-cased name contains a score word and that hold at
    least one numeric value (B18).  One aggregate for all candidates."""
    cands = [x for x in df.columns if any(w in x.lower() for w in words)]
    if not cands:
        return []
    row = df.agg(*[F.count(num(df, x)).alias(f"_{i}") for i, x in enumerate(cands)]).first()
    return [x for i, x in enumerate(cands) if row[f"_{i}"] > 0]


def sheet_scores(df: DataFrame, sheet_name: str | None = None, sheet_col: str | None = None,
                 entity: str | None = None, score_cols: list[str] | None = None) -> DataFrame:
    """Per entity row: mean of its score cells and how many were used.

    Either ``sheet_name`` (one sheet) or ``sheet_col`` (a column naming the sheet
    of each row, many sheets at once) gives ``Planilha``.
    """
    entity = entity or entity_column(df)
    score_cols = score_cols if score_cols is not None else keyword_columns(df)
    if entity is None or not score_cols:
        raise ValueError("no entity column or no score column found")
    sheet = c(sheet_col) if sheet_col else F.lit(sheet_name)
    base = df.filter(c(entity).isNotNull()).select(
        c(entity).cast("string").alias(ENTITY), sheet.alias(SHEET), *[c(x) for x in score_cols])
    return row_mean(base, score_cols, keep=[ENTITY, SHEET], mean_name=MEAN, count_name=USED)


def entity_means(records: DataFrame, entity: str = ENTITY, value: str = "Valor",
                 sheet: str = SHEET) -> DataFrame:
    """Mean and count of long score records per entity and sheet."""
    return records.filter(c(value).isNotNull()).groupBy(c(sheet).alias(SHEET), c(entity).alias(ENTITY)).agg(
        F.avg(c(value)).alias(MEAN), F.count(c(value)).alias(USED))


def rank_in_sheet(scores: DataFrame, sheet: str = SHEET, entity: str = ENTITY,
                  mean: str = MEAN) -> DataFrame:
    """Rank 1..n per sheet by mean descending (name ascending on ties) plus the
    medal label (E1).  Uses range-bucketed positions, so a sheet holding a third
    of all rows is still ranked by many tasks."""
    tmp = scores.withColumn("_neg", -c(mean))
    ranked = dense_position(tmp, ["_neg", entity], by=[sheet], out="_pos")
    rank = (F.col("_pos") + 1).cast("long")
    medal = F.when(rank == 1, MEDALS[0]).when(rank == 2, MEDALS[1]).when(rank == 3, MEDALS[2]).otherwise(OTHER_MEDAL)
    return ranked.withColumn("rank", rank).withColumn("medal", medal).drop("_neg", "_pos")


def sheet_stats(scores: DataFrame, sheet: str = SHEET, mean: str = MEAN) -> DataFrame:
    """Per sheet: number of entities, mean, min, max rounded to 2 (half-even, D20)."""
    return scores.groupBy(c(sheet).alias(SHEET)).agg(
        F.count(F.lit(1)).alias("escolas"),
        F.bround(F.avg(c(mean)), 2).alias("media"),
        F.bround(F.min(c(mean)), 2).alias("minimo"),
        F.bround(F.max(c(mean)), 2).alias("maximo"))


def sheet_spread(scores: DataFrame, sheet: str = SHEET, mean: str = MEAN) -> DataFrame:
    """Per sheet mean, sample std and range, plus the overall row count,
    sheet count and mean on every row (D21)."""
    per = scores.groupBy(c(sheet).alias(SHEET)).agg(
        F.avg(c(mean)).alias("sheet_mean"), F.stddev_samp(c(mean)).alias("sheet_std"),
        (F.max(c(mean)) - F.min(c(mean))).alias("sheet_range"),
        F.count(F.lit(1)).alias("sheet_rows"))
    overall = scores.agg(F.count(F.lit(1)).alias("total_rows"),
                         F.countDistinct(c(sheet)).alias("total_sheets"),
                         F.avg(c(mean)).alias("overall_mean"))
    return per.crossJoin(F.broadcast(overall))


def comparison_matrix(scores: DataFrame, sheets: list[str] | None = None) -> DataFrame:
    """Entity x sheet mean matrix (D16 / K17).  Pass ``sheets`` to skip the
    extra job that discovers the pivot values."""
    g = scores.groupBy(ENTITY)
    g = g.pivot(SHEET, sheets) if sheets is not None else g.pivot(SHEET)
    return g.agg(F.avg(MEAN))


def engagement_matrix(records: DataFrame, min_shape: int = 2) -> DataFrame:
    """Mean per (entity, "Area - Metrica") in long form.

    The reference shows the pivot only when it is at least 2 x 2; the long form
    is returned either way, with the matrix shape on every row."""
    means = records.groupBy("Escola", F.concat_ws(" - ", "Area", "Metrica").alias("area_metrica")).agg(
        F.avg("Valor").alias("media"))
    shape = means.agg(F.countDistinct("Escola").alias("n_rows"),
                      F.countDistinct("area_metrica").alias("n_cols"))
    return means.crossJoin(F.broadcast(shape)).withColumn(
        "shown", (F.col("n_rows") >= min_shape) & (F.col("n_cols") >= min_shape))


def score_report(scores: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """The report's data as one table (A22): per entity and sheet the rank,
    medal, mean, values used; the sheet's n / mean / std / range; overall mean.
    ``ranked`` is their ranking, if it is there already."""
    ranked = rank_in_sheet(scores) if ranked is None else ranked
    spread = sheet_spread(scores)
    return ranked.join(spread, SHEET, "left")
