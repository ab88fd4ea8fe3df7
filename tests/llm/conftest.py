import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) tuples."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


#: Names that operators also use inside, as further columns of the input.
CLASHES = ["x", "cls", "places", "size", "h", "_row", "target", "kept", "k", "comp", "n_words", "rid", "tid"]


@pytest.fixture(scope="session")
def with_clashes():
    from pyspark.sql import functions as F
    return lambda df: df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="session")
def sample(spark):
    """All small-scale documents, as rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
