"""Column type detection.

Two vocabularies, as in the reference: a semantic one (date, email, phone,
cpf, currency, percentage, code, numeric, categorical) and a structural one
(empty, datetime, numeric, categorical, text).  Both are decided from one
aggregate over all columns, then shaped into one row per column with
``inline`` - no per-column jobs, nothing row-level on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.columns import c, loose_numeric, text_to_double
from gridscope.operators.aggregates import long_value_counts, top_values
from gridscope.operators.order import quantiles
from gridscope.session import materialize

# Regex families of the semantic detector, in the order they are tried
PATTERNS = {
    "date": [
        r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
        r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
        r"\d{1,2}\s+(jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez)",
        r"(segunda|terça|quarta|quinta|sexta|sábado|domingo)",
    ],
    "email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "phone": [
        r"\(\d{2}\)\s*\d{4,5}[-\s]*\d{4}",
        r"\d{2}\s*\d{4,5}[-\s]*\d{4}",
        r"\+55\s*\d{2}\s*\d{4,5}[-\s]*\d{4}",
    ],
    "cpf": [r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{11}"],
    "currency": [
        r"R\$\s*\d+[.,]\d{2}",
        r"\$\s*\d+[.,]\d{2}",
        r"\d+[.,]\d{2}\s*(reais|real|R\$)",
    ],
    "percentage": [
        r"\d+[.,]?\d*\s*%",
        r"\d+[.,]?\d*\s*(por\s*cento|porcento)",
    ],
    "code": [
        r"^[A-Z]{2,5}\d{3,8}$",
        r"^[A-Z]\d{3,8}[A-Z]?$",
    ],
}
# Structural detector's date patterns, matched at the start of the trimmed text
START_DATE_PATTERNS = [
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{2,4}-\d{1,2}-\d{1,2}",
    r"\d{1,2}-\d{1,2}-\d{2,4}",
    r"\w+ \d{1,2}, \d{4}",
]
# Patterns of the statistics module's date-column test
STAT_DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
]

NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}
TIME_TYPES = {"timestamp", "timestamp_ntz", "date"}


def as_text(df: DataFrame, name: str):
    """The column as the text a spreadsheet shows (timestamps as ISO text)."""
    t = dict(df.dtypes)[name]
    if t in TIME_TYPES:
        return F.date_format(c(name), "yyyy-MM-dd HH:mm:ss")
    return c(name).cast("string")


def _ci(p: str) -> str:
    """Case-insensitive form of a pattern, like Python's re.I on str: Unicode
    folding only when the pattern has non-ASCII letters, ASCII folding when
    it has letters, no flag when it has none (cheaper, same matches)."""
    import re as _re
    bare = _re.sub(r"\\.", "", p)
    if any(ord(ch) > 127 for ch in bare):
        return "(?iu)" + p
    if _re.search(r"[A-Za-z]", bare):
        return "(?i)" + p
    return p


def _necessary(fam: str, k: int, s):
    """A cheap condition every match of pattern ``k`` of family ``fam`` needs
    (a literal character or a minimum length), tested before the regex; None
    when there is no useful one.  Only an optimisation: results are unchanged."""
    low = F.lower(s)
    n = F.length(s)
    table = {
        ("date", 0): s.contains("-") | s.contains("/"),
        ("date", 1): s.contains("-") | s.contains("/"),
        ("email", 0): s.contains("@"),
        ("phone", 0): s.contains("("),
        ("phone", 1): n >= 10,
        ("phone", 2): s.contains("+55"),
        ("cpf", 0): s.contains(".") & s.contains("-"),
        ("cpf", 1): n >= 11,
        ("currency", 0): s.contains("$"),
        ("currency", 1): s.contains("$"),
        ("currency", 2): s.contains("$") | low.contains("rea"),
        ("percentage", 0): s.contains("%"),
        ("percentage", 1): low.contains("cento"),
        ("code", 0): n.between(5, 15),  # "$" also matches before a final line break
        ("code", 1): n.between(4, 12),
    }
    return table.get((fam, k))


def _match(fam: str, k: int, p: str, s):
    cond = _necessary(fam, k, s)
    m = s.rlike(_ci(p))
    return m if cond is None else (cond & m)


def pattern_scores(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, family, matches, non_null, score)``; score =
    matches summed over the family's regexes / non-null values (may exceed 1)."""
    cols = cols or df.columns
    # the text form is computed once per row (formatting a timestamp is not
    # cheap), then every pattern reads the projected column
    txt = df.select(*[as_text(df, x).alias(f"_t{i}") for i, x in enumerate(cols)])
    aggs = []
    for i, x in enumerate(cols):
        s = F.col(f"_t{i}")
        aggs.append(F.count(s).alias(f"nn{i}"))
        for fam, pats in PATTERNS.items():
            tot = sum((F.count_if(_match(fam, k, p, s)) for k, p in enumerate(pats)), F.lit(0))
            aggs.append(tot.alias(f"{fam}{i}"))
    row = txt.agg(*aggs)
    recs = []
    for i, x in enumerate(cols):
        for fam in PATTERNS:
            recs.append(F.struct(F.lit(x).alias("column"), F.lit(fam).alias("family"),
                                 F.col(f"{fam}{i}").cast("long").alias("matches"),
                                 F.col(f"nn{i}").alias("non_null"),
                                 F.when(F.col(f"nn{i}") > 0, F.col(f"{fam}{i}") / F.col(f"nn{i}")).alias("score")))
    return row.select(F.inline(F.array(*recs)))


def numeric_candidates(df: DataFrame, cols: list[str] | None = None, rows: int | None = None,
                       with_median: bool = True) -> DataFrame:
    """Per column the share of all rows that parse as numbers; when above
    0.8 the confidence, statistics and subtype (integer / float, then
    scale_0_10 or scale_0_100 when the range fits)."""
    cols = cols or df.columns
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), _num(df, x).alias("value")) for x in cols])))
    rows = df.count() if rows is None else rows
    st = long.groupBy("column").agg(
        F.count("value").alias("parsed"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.count_if(F.col("value") != F.floor("value")).alias("_frac"))
    if with_median:
        med = quantiles(long.filter(F.col("value").isNotNull()), "value", [0.5], by=["column"]).select(
            "column", F.col("q").alias("median"))
        st = st.join(med, "column", "left")
    else:
        st = st.withColumn("median", F.lit(None).cast("double"))
    conf = F.try_divide(F.col("parsed"), F.lit(rows))
    sub = (F.when((F.col("min") >= 0) & (F.col("max") <= 10), "scale_0_10")
           .when((F.col("min") >= 0) & (F.col("max") <= 100), "scale_0_100")
           .when(F.col("_frac") == 0, "integer").otherwise("float"))
    ok = (conf > 0.8) & (F.col("parsed") > 0)
    return st.select(
        "column", F.lit(rows).alias("rows"), "parsed",
        F.when(ok, conf).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, sub).alias("subtype"), "mean", "median", "std", "min", "max",
        (F.col("max") - F.col("min")).alias("range"), "skewness", "kurtosis")


def _num(df: DataFrame, x: str):
    t = dict(df.dtypes)[x]
    if t in NUMERIC_TYPES or t.startswith("decimal"):
        return c(x).cast("double")
    if t == "boolean" or t in TIME_TYPES:
        return F.lit(None).cast("double")
    return text_to_double(c(x))


def text_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, count) of the columns as text: one shuffle, shared by
    the categorical, quality and profile operators."""
    return long_value_counts(df.select(*[as_text(df, x).alias(x) for x in cols]), cols)


def categorical_candidates(df: DataFrame, cols: list[str] | None = None, rows: int | None = None,
                           vc: DataFrame | None = None) -> DataFrame:
    """Distinct / rows ratio; below 0.5 the confidence is 1 - ratio, with
    the top value, its count and a cardinality class (<=10, <=50, more).
    Uses the long value-count table: one shuffle for all columns."""
    cols = cols or df.columns
    rows = df.count() if rows is None else rows
    vc = text_value_counts(df, cols) if vc is None else vc
    agg = vc.groupBy("column").agg(
        F.count("value").alias("distinct"),
        F.min_by("value", F.struct(F.negative("count"), F.col("value"))).alias("top_value"),
        F.max("count").alias("top_count"))
    ratio = F.try_divide(F.col("distinct"), F.lit(rows))
    agg = agg.join(top_values(vc, 10), "column", "left")
    return agg.select(
        "column", "distinct", ratio.alias("cardinality_ratio"), "top_values",
        F.when(ratio < 0.5, 1 - ratio).otherwise(F.lit(0.0)).alias("confidence"),
        "top_value", "top_count",
        F.when(F.col("distinct") <= 10, "low_cardinality").when(F.col("distinct") <= 50, "medium_cardinality")
        .otherwise("high_cardinality").alias("subtype"))


def quality_scores(df: DataFrame, cols: list[str] | None = None, rows: int | None = None,
                   vc: DataFrame | None = None) -> DataFrame:
    """max(0, 1 - 0.5 * null share - 0.3 * duplicate share), where
    duplicates = rows - distinct values (NULL counted as one value)."""
    cols = cols or df.columns
    rows = df.count() if rows is None else rows
    vc = text_value_counts(df, cols) if vc is None else vc
    agg = vc.groupBy("column").agg(F.count("value").alias("distinct"), F.sum("count").alias("non_null"))
    allc = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    agg = allc.join(agg, "column", "left").fillna(0, ["distinct", "non_null"])
    nulls = F.lit(rows) - F.col("non_null")
    dup = F.lit(rows) - F.col("distinct") - F.when(nulls > 0, 1).otherwise(0)
    score = F.greatest(F.lit(0.0), 1 - 0.5 * nulls / F.lit(rows) - 0.3 * dup / F.lit(rows))
    return agg.select("column", nulls.alias("nulls"), dup.alias("duplicates"),
                      (score if rows else F.lit(0.0)).alias("quality_score"))


def value_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value as text, count), nulls included, written once: the one scan
    and the one shuffle over rows that type detection needs."""
    txt = df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), as_text(df, x).alias("value")) for x in cols])))
    return materialize(txt.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")), "values")


def _numeric_names(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns whose text may be read as numbers (not times or booleans)."""
    t = dict(df.dtypes)
    return [x for x in cols if t[x] not in TIME_TYPES and t[x] != "boolean"]


def semantic_details(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C1-C5 in full, one row per column: ``(column, type, subtype, confidence,
    quality_score, distinct, rows, nulls, duplicates, patterns_found, statistics,
    top_values)``.  Patterns are matched once per distinct value and weighted by
    its count."""
    cols = cols or df.columns
    vt = value_table(df, cols)
    v, n = F.col("value"), F.col("count")
    d = F.when(F.col("column").isin(_numeric_names(df, cols)), text_to_double(v))
    fams = {f: sum((F.sum(F.when(_match(f, k, p, v), n).otherwise(0)) for k, p in enumerate(ps)), F.lit(0)) for f, ps in PATTERNS.items()}
    vt = vt.withColumn("_d", d)
    mean = F.sum(F.col("_d") * n) / F.sum(F.when(F.col("_d").isNotNull(), n))
    per = vt.groupBy("column").agg(
        F.sum("count").alias("rows"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("nulls"), F.count("value").alias("distinct"),
        *[x.alias(f"_f_{f}") for f, x in fams.items()], F.sum(F.when(F.col("_d").isNotNull(), n).otherwise(0)).alias("_parsed"),
        F.min("_d").alias("_min"), F.max("_d").alias("_max"), mean.alias("_mean"),
        F.count_if(F.col("_d") != F.floor("_d")).alias("_frac")).join(top_values(vt.filter(v.isNotNull()), 10), "column", "left")
    nn = F.col("rows") - F.col("nulls")
    score = {f: F.try_divide(F.col(f"_f_{f}"), nn) for f in PATTERNS}
    number = F.try_divide(F.col("_parsed"), F.col("rows"))
    ratio = F.try_divide(F.col("distinct"), F.col("rows"))
    scale = (F.when((F.col("_min") >= 0) & (F.col("_max") <= 10), "scale_0_10")
             .when((F.col("_min") >= 0) & (F.col("_max") <= 100), "scale_0_100")
             .when(F.col("_frac") == 0, "integer").otherwise("float"))
    card = (F.when(F.col("distinct") <= 10, "low_cardinality").when(F.col("distinct") <= 50, "medium_cardinality")
            .otherwise("high_cardinality"))
    none = F.lit(None).cast("string")
    ranked = [F.struct(F.coalesce(score[f], F.lit(0.0)).alias("confidence"), F.lit(-i).alias("o"), F.lit(f).alias("type"), none.alias("subtype"))
              for i, f in enumerate(PATTERNS)]
    ranked.append(F.struct(F.when((number > 0.8) & (F.col("_parsed") > 0), number).otherwise(0.0).alias("confidence"),
                           F.lit(-len(PATTERNS)).alias("o"), F.lit("numeric").alias("type"), scale.alias("subtype")))
    ranked.append(F.struct(F.when((ratio < 0.5) & (F.col("distinct") > 0), 1 - ratio).otherwise(0.0).alias("confidence"),
                           F.lit(-len(PATTERNS) - 1).alias("o"), F.lit("categorical").alias("type"), card.alias("subtype")))
    per = per.withColumn("_b", F.greatest(*ranked))  # the highest confidence; among equals the first family
    won = F.col("_b.confidence") > 0
    dup = F.col("rows") - F.col("distinct") - F.when(F.col("nulls") > 0, 1).otherwise(0)
    quality = F.greatest(F.lit(0.0), 1 - 0.5 * F.col("nulls") / F.col("rows") - 0.3 * dup / F.col("rows"))
    found = F.filter(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"_f_{f}").cast("long").alias("matches"), score[f].alias("score"))
                               for f in PATTERNS]), lambda x: x["matches"] > 0)
    stats = F.when(F.col("_parsed") > 0, F.struct(F.col("_min").alias("min"), F.col("_max").alias("max"), F.col("_mean").alias("mean"),
                                                  F.col("_parsed").alias("parsed")))
    base = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    got = per.select(
        "column", F.when(won, F.col("_b.type")).otherwise("unknown").alias("type"), F.when(won, F.col("_b.subtype")).alias("subtype"),
        F.col("_b.confidence").alias("confidence"), quality.alias("quality_score"), "distinct", "rows", "nulls",
        dup.alias("duplicates"), found.alias("patterns_found"), stats.alias("statistics"), "top_values")
    return base.join(F.broadcast(got), "column", "left").select(
        "column", F.coalesce("type", F.lit("unknown")).alias("type"), "subtype", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "rows", "nulls", "duplicates", "patterns_found", "statistics", "top_values")


def semantic_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C4: the family with the highest confidence; families in order, then
    numeric, then categorical, and a later one wins only when strictly higher.
    Returns ``(column, type, subtype, confidence, quality_score, distinct)``."""
    return semantic_details(df, cols).select("column", "type", "subtype", "confidence", "quality_score", "distinct")


def structural_types(df: DataFrame, cols: list[str] | None = None, vc: DataFrame | None = None) -> DataFrame:
    """Empty -> datetime (> 70 % of values start with a date pattern)
    -> numeric (every value parses, directly or after keeping only digits and
    signs; at least one must parse) -> categorical (distinct share < 0.5 and
    < 50 distinct) -> text (mean length > 3) -> categorical.

    Whole-column shares instead of the reference's first-100-values sample,
    so the answer does not depend on file order.  Everything is computed once per
    distinct value (``vc``, if given, is a ``(column, value, count)`` table)."""
    cols = cols or df.columns
    vt = (value_table(df, cols) if vc is None else vc).filter(F.col("value").isNotNull())
    v, n = F.col("value"), F.col("count")
    date_rx = "^(" + "|".join(START_DATE_PATTERNS) + ")"
    cleaned = F.regexp_replace(v, r"[^0-9.,+\-]", "")
    weight = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    vt = vt.withColumn("_ld", loose_numeric(v))
    per = vt.groupBy("column").agg(
        F.sum("count").alias("non_null"), F.count("value").alias("distinct"), weight(F.trim(v).rlike(date_rx)).alias("_dt"),
        weight(text_to_double(v).isNull()).alias("_bad"), weight(F.col("_ld").isNull() & (cleaned != "")).alias("_lbad"),
        weight(F.col("_ld").isNotNull()).alias("_lok"), (F.sum(F.length(v) * n) / F.sum("count")).alias("_len"))
    base = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    per = base.join(F.broadcast(per), "column", "left").fillna(0, ["non_null", "distinct"])
    nn = F.col("non_null")
    numeric = (F.col("_bad") == 0) | ((F.col("_lbad") == 0) & (F.col("_lok") > 0))
    kind = (F.when(nn == 0, "empty")
            .when(F.col("_dt") / nn > 0.7, "datetime")
            .when(numeric, "numeric")
            .when((F.col("distinct") / nn < 0.5) & (F.col("distinct") < 50), "categorical")
            .when(F.col("_len") > 3, "text")
            .otherwise("categorical"))
    return per.select("column", kind.alias("type"), "non_null", "distinct")


def date_like_columns(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Text / date / timestamp columns where every value parses as a
    timestamp, or more than ``share`` match one of the statistics module's
    date patterns.  Numeric columns are never dates (unlike the reference,
    where integers parse as nanoseconds)."""
    cand = [n for n, t in df.dtypes if t == "string" or t in TIME_TYPES]
    spark = df.sparkSession
    if not cand:
        return spark.createDataFrame([], "column string, parsed_share double, pattern_share double, is_date boolean")
    aggs = []
    for i, x in enumerate(cand):
        t = dict(df.dtypes)[x]
        parsed = c(x) if t in TIME_TYPES else F.try_to_timestamp(c(x))
        aggs += [F.count(c(x)).alias(f"nn{i}"), F.count(parsed).alias(f"p{i}")]
        for j, p in enumerate(STAT_DATE_PATTERNS):
            aggs.append(F.count_if(as_text(df, x).rlike(p)).alias(f"m{i}_{j}"))
    row = df.agg(*aggs)
    recs = []
    for i, x in enumerate(cand):
        nn = F.col(f"nn{i}")
        best = F.try_divide(F.greatest(*[F.col(f"m{i}_{j}") for j in range(len(STAT_DATE_PATTERNS))]), nn)
        ps = F.try_divide(F.col(f"p{i}"), nn)
        recs.append(F.struct(F.lit(x).alias("column"), ps.alias("parsed_share"), best.alias("pattern_share"),
                             ((nn > 0) & ((ps == 1.0) | (best > share))).alias("is_date")))
    return row.select(F.inline(F.array(*recs)))
