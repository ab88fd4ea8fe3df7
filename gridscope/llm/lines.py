"""Operator 1: line dedup.

Native: DataFrame functions only.

``dedup_runs`` (the query and the pipeline) removes every repeated run of lines.  A
text is split at ``\\n``; each place where ``MIN_LINES`` consecutive lines start is a
key, so that a run of that many lines or more is found wherever it stands, at the
ends of a text as well as between other lines.  Keys that occur more than once are
compared byte by byte with their first occurrence (smallest doc_id, then text hash,
then place); the lines of equal ones go.

``dedup_lines`` removes content-defined chunks, and of a repeated run only the
chunks that lie inside it.  A chunk starts wherever the rolling hash over the hashes
of ``WINDOW`` lines is smaller than at both neighbouring lines, so boundaries
depend on nearby lines only, survive insertions elsewhere, and lie two or more
lines apart.  Chunks of at least ``MIN_LINES`` lines that occur more than once in the whole corpus are compared byte by byte
with their first occurrence (smallest doc_id, then text hash, then place) and
removed when equal.

Texts travel twice (to collect the possible repeats, and to cut them); all other
shuffles carry hashes and places only.  Counts are combined before the shuffle and
hot chunks are joined against one row each, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import documents, stored, text_of

WINDOW = 2
MIN_LINES = 2


def chunks_of(text: Column, window: int = WINDOW) -> Column:
    """array<struct<n: lines, body: text>>: joined by ``\\n`` they are the text."""
    lines = F.split(text, "\n", -1)

    def places(ls: Column) -> Column:
        """Where chunks start, and the number of lines."""
        most = F.lit(2 ** 63 - 1)
        hashes = F.array(F.transform(ls, lambda x: F.xxhash64(x)))
        rolled = F.transform(hashes, lambda h: F.transform(h, lambda _, i: F.when(
            i >= window - 1, F.xxhash64(*[F.get(h, i - F.lit(k)) for k in range(window)]))))
        at = F.flatten(F.transform(rolled, lambda r: F.filter(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: (
            (i < F.size(r)) & (F.get(r, i) < F.coalesce(F.get(r, i - 1), most)) & (F.get(r, i) <= F.coalesce(F.get(r, i + 1), most))))))
        return F.concat(F.array(F.lit(0)), at, F.array(F.size(ls)))

    both = F.transform(F.array(lines), lambda ls: F.struct(ls.alias("ls"), places(ls).alias("at")))
    return F.flatten(F.transform(both, lambda b: F.transform(
        F.sequence(F.lit(0), F.size(b["at"]) - 2),
        lambda k: F.struct((F.get(b["at"], k + 1) - F.get(b["at"], k)).alias("n"),
                           F.array_join(F.slice(b["ls"], F.get(b["at"], k) + 1, F.get(b["at"], k + 1) - F.get(b["at"], k)), "\n").alias("body")))))


def _keyed(docs: DataFrame) -> DataFrame:
    """The key of a row is its id and the hash of its text, so that repeated ids
    with different texts stay apart."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", text_of("_row.text").alias("_text")).withColumn(
        "_d", F.coalesce(F.col("_row.doc_id").cast("string"), F.lit(""))).withColumn("_x", F.xxhash64("_text"))


def repeated_chunks(docs: DataFrame, window: int = WINDOW,
                    min_lines: int = MIN_LINES) -> DataFrame:
    """(_d, _x, places): per row key the chunks to remove."""
    keyed = _keyed(docs.select("doc_id", "text"))
    order = F.col("_row.doc_id")
    cut = keyed.select("_d", "_x", order.alias("_o"), F.posexplode(chunks_of(F.col("_text"), window)).alias("p", "c"))
    slim = stored(cut.filter((F.col("c.n") >= min_lines) & (F.trim("c.body") != "")).select(
        "_d", "_x", "p", F.xxhash64("c.body").alias("h"), F.octet_length("c.body").alias("b")), "chunk-places")
    often = slim.groupBy("h", "b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    hits = slim.join(often, ["h", "b"]).groupBy("_d", "_x").agg(F.collect_set("p").alias("places"))
    # Bodies of the possible repeats only.
    bodies = keyed.select("_d", "_x", order.alias("_o"), "_text").join(hits, ["_d", "_x"]).select(
        "_d", "_x", "_o", "places", chunks_of(F.col("_text"), window).alias("cs"))
    bodies = bodies.select("_d", "_x", "_o", F.explode("places").alias("p"), "cs").select(
        "_d", "_x", "_o", "p", F.get("cs", F.col("p"))["body"].alias("body"))
    bodies = stored(bodies.withColumn("h", F.xxhash64("body")).withColumn("b", F.octet_length("body")), "chunk-bodies")
    place = F.struct("_o", "_d", "_x", "p")
    first = bodies.groupBy("h", "b").agg(F.min_by("body", place).alias("first_body"), F.min(place).alias("first"))
    same = bodies.join(first, ["h", "b"]).filter((F.col("body") == F.col("first_body")) & (place != F.col("first")))
    return same.groupBy("_d", "_x").agg(F.collect_set("p").alias("places"))


def dedup_lines(docs: DataFrame, window: int = WINDOW,
                min_lines: int = MIN_LINES, counts: bool = False) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``; all rows and columns
    stay (``counts`` adds n_chunks, n_removed and removed_bytes).

    A null text stays null; an empty one is one blank chunk and stays.  Blank
    chunks are never removed.  Rows with equal id and text count as one document:
    each copy keeps what the first keeps.  Chunks repeated inside one document
    stay at their first place.  An empty table gives an empty one.  Further
    columns are carried along, whatever their names."""
    found = repeated_chunks(docs, window, min_lines)
    keyed = _keyed(docs).join(found, ["_d", "_x"], "left")
    cs = F.when(F.col("places").isNotNull(), chunks_of(F.col("_text"), window))
    keyed = keyed.withColumn("_cs", cs)
    left = F.filter("_cs", lambda c, i: ~F.array_contains(F.col("places"), i))
    cut = F.when(F.col("places").isNull(), F.col("_row.text")).otherwise(
        F.array_join(F.transform(left, lambda c: c["body"]), "\n"))
    cols = [cut.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        gone = F.filter("_cs", lambda c, i: F.array_contains(F.col("places"), i))
        cols += [F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed_chunks"),
                 F.coalesce(F.aggregate(gone, F.lit(0), lambda a, c: a + c["n"]), F.lit(0)).cast("long").alias("n_removed_lines")]
    return keyed.select(*cols)


def _starts(lines: Column, run: int) -> Column:
    """array<struct<h, b>>: hash and bytes of the ``run`` lines from each line on;
    null where all are blank."""
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("b"), (F.trim(x) != "").alias("s")))
    return F.flatten(F.transform(F.array(each), lambda ls: F.transform(
        F.slice(ls, 1, F.greatest(F.size(ls) - (run - 1), F.lit(0))), lambda _, i: F.when(
            F.exists(F.slice(ls, i + 1, run), lambda x: x["s"]),
            F.struct(F.xxhash64(*[F.get(ls, i + k)["h"] for k in range(run)]).alias("h"),
                     sum((F.get(ls, i + k)["b"] for k in range(run)), F.lit(0)).alias("b"))))))


def repeated_runs(docs: DataFrame, run: int = MIN_LINES) -> DataFrame:
    """(_d, _x, places): per row key the lines (from 0) at which ``run`` lines start
    that stand earlier in the corpus."""
    keyed = _keyed(docs.select("doc_id", "text"))
    lines, order = F.split("_text", "\n", -1), F.col("_row.doc_id").alias("_o")
    slim = stored(keyed.select("_d", "_x", F.posexplode(_starts(lines, run)).alias("p", "c")).filter("c IS NOT NULL").select(
        "_d", "_x", "p", "c.h", "c.b"), "line-places")
    often = slim.groupBy("h", "b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    hits = slim.join(often, ["h", "b"]).groupBy("_d", "_x").agg(F.collect_set("p").alias("places"))
    # Lines of the possible repeats only.
    bodies = keyed.select("_d", "_x", order, "_text").join(hits, ["_d", "_x"]).withColumn("_ls", lines)
    body = F.transform(F.array("_ls"), lambda ls: F.transform("places", lambda p: F.struct(
        p.alias("p"), F.array_join(F.slice(ls, p + 1, run), "\n").alias("body"),
        F.xxhash64(*[F.xxhash64(F.get(ls, p + k)) for k in range(run)]).alias("h"))))
    bodies = stored(bodies.select("_d", "_x", "_o", F.inline(F.flatten(body))).withColumn("b", F.octet_length("body") - (run - 1)), "line-bodies")
    place = F.struct("_o", "_d", "_x", "p")
    first = bodies.groupBy("h", "b").agg(F.min_by("body", place).alias("first_body"), F.min(place).alias("first"))
    # Lines that overlap with their own first occurrence are part of it.
    apart = ~((F.col("_d") == F.col("first._d")) & (F.col("_x") == F.col("first._x")) & (F.col("p") - F.col("first.p") < run))
    same = bodies.join(first, ["h", "b"]).filter((F.col("body") == F.col("first_body")) & apart)
    return same.groupBy("_d", "_x").agg(F.collect_set("p").alias("places"))


def dedup_runs(docs: DataFrame, run: int = MIN_LINES, counts: bool = False) -> DataFrame:
    """``docs`` without any run of ``run`` or more lines that stands earlier in the
    corpus; all rows and columns stay (``counts`` adds n_removed_chunks, the stretches
    of lines cut out, and n_removed_lines).

    So every later exact copy of a text with that many lines is emptied, and one copy
    of each line stays.  A null text stays null; runs of blank lines alone are no
    repeats, but go when nothing else is left of a cut text.  Rows with equal id and
    text count as one document: each copy keeps what the first keeps.  Runs repeated
    inside one document stay at their first place.  An empty table gives an empty one.
    Further columns are carried along, whatever their names."""
    found = repeated_runs(docs, run)
    gone = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (run - 1)))))
    keyed = _keyed(docs).join(found.select("_d", "_x", gone.alias("_gone")), ["_d", "_x"], "left")
    keyed = keyed.withColumn("_ls", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n", -1)))
    left = F.flatten(F.transform(F.array("_ls"), lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone")), lambda i: F.get(ls, i))))
    keyed = keyed.withColumn("_left", left)
    keyed = keyed.withColumn("_left", F.when(F.exists("_left", lambda x: F.trim(x) != ""), F.col("_left")).otherwise(
        F.array().cast("array<string>")))
    cut = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join("_left", "\n"))
    cols = [cut.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        stretches = F.size(F.array_except("_gone", F.transform("_gone", lambda i: i + 1)))
        cols += [F.when(F.col("_gone").isNull(), 0).otherwise(stretches).cast("long").alias("n_removed_chunks"),
                 F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_ls") - F.size("_left")).cast("long").alias("n_removed_lines")]
    return keyed.select(*cols)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stand elsewhere before."""
    out = dedup_runs(documents(spark, sf_dir, "doc_id", "text"), counts=True)
    return out.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes_left"),
                      "n_removed_chunks", "n_removed_lines", F.sha2(text_of(), 256).alias("kept_sha256"), "text")
