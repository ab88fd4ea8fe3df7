"""Every catalogue query against its DuckDB oracle (small scale), and every
rows-only query for a stable schema."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare

from paths import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck_small, name):
    df = QUERIES[name](spark, SF_SMALL)
    sp = df.toPandas()
    rel = duck_small.sql(ORACLES[name])
    dk = rel.df()
    r = compare(sp, dk)
    assert r is None or r.startswith("strict-diff"), f"{name}: {r}"
    sp_types = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dk_types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    assert sp_types == dk_types, name


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    assert rows, "a query over the given tables has rows"
    assert all(v is None or v == v for r in rows for v in r if isinstance(v, float)), "no NaN"
    again = QUERIES[name](spark, SF_SMALL)
    assert again.schema == df.schema
    assert len(again.collect()) == len(rows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"Planilha", "Escola", "Media", "Valores_Utilizados", "rank", "medal"}
