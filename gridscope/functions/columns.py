"""Column-level helpers.  All return ``pyspark.sql.Column`` expressions that stay
inside whole-stage codegen (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> str:
    """Back-quote a column name (names may contain dots or spaces)."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


# Numeric text accepted by the parsers: optional sign, digits with an optional
# decimal point (or a leading point), optional exponent, surrounding blanks.
NUMBER_RX = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(col: Column) -> Column:
    """Lenient numeric parse of a numeric or text column: NaN becomes NULL.
    Prefer ``text_to_double`` for text (no failed casts)."""
    d = col.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def text_to_double(col: Column) -> Column:
    """Parse numeric text; anything else is NULL.  The regex gate keeps the
    cast from failing (a failed ANSI cast costs an exception per row)."""
    return F.when(col.rlike(NUMBER_RX), col.try_cast("double"))


def num(df, name: str) -> Column:
    """A column of ``df`` as a double: numbers cast, text parsed, other types NULL."""
    t = dict(df.dtypes)[name]
    if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
        d = c(name).cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d) if t in ("float", "double") else d
    if t == "string":
        return text_to_double(c(name))
    return F.lit(None).cast("double")


def parse_percent(col: Column) -> Column:
    """Score text such as ``'75,5 +'`` -> 75.5.

    Removes ``+``, ``-`` and ``=`` (so a minus sign is dropped and negatives
    turn positive, as the score sheets use ``-`` as a trend mark), trims,
    turns a decimal comma into a point and parses; anything else is NULL.
    """
    s = F.trim(F.translate(col.cast("string"), "+-=", ""))
    return text_to_double(F.regexp_replace(s, ",", "."))


def loose_numeric(col: Column) -> Column:
    """Keep only digits, ``.``, ``,``, ``+``, ``-``; comma -> point; parse."""
    s = F.regexp_replace(col.cast("string"), r"[^0-9.,+\-]", "")
    return text_to_double(F.regexp_replace(s, ",", "."))


def rnd(col: Column, digits: int = 6) -> Column:
    """Round a double for stable comparison; -0.0 is folded to 0.0."""
    r = F.round(col.cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(df, name: str) -> Column:
    """Microseconds since 1970-01-01 of a time column, independent of the
    session time zone: instants (TIMESTAMP) by ``unix_micros``, wall-clock
    values (TIMESTAMP_NTZ, DATE, text) read as UTC wall clock."""
    t = dict(df.dtypes)[name]
    if t == "timestamp":
        return F.unix_micros(c(name))
    if t == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, {_NTZ_EPOCH}, {q(name)})")
    if t == "date":
        return F.unix_date(c(name)).cast("long") * 86_400_000_000
    if t == "string":
        return F.expr(f"timestampdiff(MICROSECOND, {_NTZ_EPOCH}, try_cast({q(name)} AS TIMESTAMP_NTZ))")
    return F.lit(None).cast("long")


def epoch_seconds(df, name: str) -> Column:
    return epoch_micros(df, name).cast("double") / 1e6


def utc_timestamp(df, name: str) -> Column:
    """A time column as an instant, reading wall-clock values as UTC."""
    return F.timestamp_micros(epoch_micros(df, name))


def utc_day(micros: Column) -> Column:
    """Calendar day (DATE) of epoch microseconds, in UTC."""
    return F.date_from_unix_date(F.floor(micros / 86_400_000_000).cast("int"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL when
    either side is constant (``corr`` raises a division by zero under ANSI
    mode, pandas gives NaN)."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b),
                        F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))
