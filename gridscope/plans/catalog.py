"""Catalogue of queries over the driver tables.

Each entry pairs a Spark query (a composition of gridscope operators over
whole tables) with the equivalent DuckDB SQL used as the oracle.  Every float
is rounded the same way on both sides; every computed column is aliased to
the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.functions.columns import rnd
from gridscope.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def round_cols(df: DataFrame, digits: dict[str, int] | int = 6) -> DataFrame:
    """Round every double column (digits per column, or one default)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            d = digits.get(f.name, 6) if isinstance(digits, dict) else digits
            out.append(rnd(F.col(f"`{f.name}`"), d).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


# import the query groups so that they register themselves
from gridscope.plans import q_scores, q_aggregates, q_clean, q_types, q_time, q_relations, q_models, q_charts, q_rules, q_history, q_sources, q_plans  # noqa: E402,F401
