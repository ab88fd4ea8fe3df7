"""Shared pieces of the operators: reading, stored intermediates, words, ids."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.session import ensure_checkpoint_dir, remember, ship_package

#: A word, as every contract of this subpackage has it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side is broadcast after it has been counted.
BROADCAST_ROWS = 20_000


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table (only ``columns``, when given)."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the cluster's shared checkpoint folder and read
    back: computed once, lineage cut, and it survives lost executors.
    ``session.release`` deletes it when results have been consumed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")  # its shuffle files go as soon as it is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run, rows: int = 1_024):
    """A ``mapInArrow`` function that takes at most ``rows`` rows at a time and gives
    its memory back to the system when the task ends; Spark keeps the worker."""
    def wrapped(batches):
        try:
            yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def joined_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a per-key table: broadcast when its counted rows are few, otherwise
    a shuffle join whose hot keys AQE splits."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = F.broadcast(small) if few else small
    cond = None
    for k in on:
        eq = df[k].eqNullSafe(right[k])
        cond = eq if cond is None else cond & eq
    out = df.join(right, cond, how)
    for k in on:
        out = out.drop(right[k])
    return out
