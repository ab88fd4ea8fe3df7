"""Delimited and JSON files of any size, read by Spark's splittable text scan.

What a piece of a file means depends on all text before it: whether it stands inside
quotes, how deep in brackets, in which row.  A scan's splits know only themselves, so

1. every piece (a line, or the text up to a comma) is stored with its file, its split
   and its place in the split;
2. each split is worked out for every state it may begin in (outside or inside
   quotes), in one ordered window over its pieces;
3. the splits' results, one row each, are combined in order of their places: this
   gives the state and the counts with which each split begins;
4. the pieces take the variant that holds.

No file is loaded whole, no task holds more than a split, and the rows are the same
for every size of split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscope.session import ensure_checkpoint_dir, materialize, remember

# The order in which separators are tried
SEPARATORS = [",", ";", "\t", "|"]

_SPLIT = ["path", "block"]


def pieces(spark: SparkSession, path: str | list[str], ending: str, glob: str | None = None) -> DataFrame:
    """(path, block, id, value), stored: the text between ``ending``s; ``block`` is the
    offset of the split, ``id`` grows inside it."""
    reader = spark.read.option("lineSep", ending)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return materialize(reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value"), "pieces")


def _inside() -> Window:
    return Window.partitionBy(*_SPLIT).orderBy("id")


def _splits_before() -> Window:
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _begin_quoted(splits: DataFrame) -> DataFrame:
    """``splits`` (one row a split, with the quote states ``e0`` and ``e1`` in which it ends
    when begun outside and inside) with ``begin``, the state in which it begins.

    A split keeps the state, flips it, or ends in one whatever came before: so the state
    is that of the last such split, flipped as often as splits flip since."""
    before = _splits_before()
    flips = splits.withColumn("_flip", (F.col("e0") & ~F.col("e1")).cast("int"))
    run = flips.withColumn("_f", F.sum("_flip").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("e"), "_f")), True).over(before)
    so_far = F.coalesce(F.sum("_flip").over(before), F.lit(0))
    run = run.withColumn("_fixed", fixed).withColumn("_so", so_far)
    since = F.when(F.col("_fixed").isNull(), F.col("_so")).otherwise(F.col("_so") - F.col("_fixed._f"))
    begin = F.coalesce(F.col("_fixed.e"), F.lit(False)) != (since % 2 == 1)
    return run.select(*splits.columns, begin.alias("begin"))


# ------------------------------------------------------------- delimited text

def first_lines(lines: DataFrame) -> DataFrame:
    """Per file its first line, whether all of it is UTF-8, and its number of lines, in one pass."""
    place = F.struct("block", "id")
    return lines.groupBy("path").agg(F.min_by("value", place).alias("head"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                                     F.count(F.lit(1)).alias("n_lines"))


def _field(sep: Column) -> Column:
    """Pattern of one field: quoted (doubled quotes inside, anything after the closing one
    up to the separator) or plain."""
    s = F.concat(F.lit("\\"), sep)
    return F.concat(F.lit('(?:"(?:[^"]|"")*+"(?:[^"'), s, F.lit("][^"), s, F.lit(']*+)?|[^"'), s, F.lit("][^"), s, F.lit("]*+|)"))


def _row(sep: Column) -> Column:
    """Pattern of the rest of a row after a field has ended."""
    return F.concat(F.lit("(?:\\"), sep, _field(sep), F.lit(")*+$"))


def _open_after(value: Column, sep: Column, quoted: bool) -> Column:
    """Whether a line ends inside quotes, begun outside or inside (``quoted``)."""
    if quoted:
        closed = F.concat(F.lit('^(?:[^"]|"")*+"(?:[^"\\'), sep, F.lit("][^\\"), sep, F.lit("]*+)?"), _row(sep))
    else:
        closed = F.concat(F.lit("^"), _field(sep), _row(sep))
    return F.when(F.contains(value, F.lit('"')), ~F.regexp_like(value, closed)).otherwise(F.lit(quoted))


def separator(head: Column, n_lines: Column) -> Column:
    """The first separator that splits the first line into several fields, when there
    are further lines; a comma otherwise."""
    found = F.lit(SEPARATORS[0])
    for s in reversed(SEPARATORS):
        more = ~F.regexp_like(head, F.concat(F.lit("^"), _field(F.lit(s)), F.lit("$")))
        found = F.when(more, F.lit(s)).otherwise(found)
    return F.when(n_lines >= 2, found).otherwise(F.lit(SEPARATORS[0]))


def fields_of(record: Column, sep: Column) -> Column:
    """The fields of one record, quotes undone."""
    each = F.regexp_extract_all(F.concat(sep, record), F.concat(F.lit("(?s)\\"), sep, F.lit("("), _field(sep), F.lit(")")), F.lit(1))
    quoted = F.transform(each, lambda x: F.when(x.startswith('"'), F.concat(
        F.replace(F.regexp_extract(x, '(?s)^"((?:[^"]|"")*+)"', 1), F.lit('""'), F.lit('"')),
        F.regexp_extract(x, '(?s)^"(?:[^"]|"")*+"(.*)$', 1))).otherwise(x))
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.split(record, F.concat(F.lit("\\"), sep), -1))


def records(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, rec, fields): the rows of delimited files, numbered from 0 in each file.

    Encoding (UTF-8 where all of the file is, else Latin-1) and separator are found per
    file.  Fields may be quoted and hold separators and line ends; blank lines are no
    rows.  An open quote at the end of a file takes the rest of it."""
    lines = pieces(spark, path, "\n", glob)
    text = lambda v, utf8: F.when(utf8, v).otherwise(F.decode(v.cast("binary"), "iso-8859-1"))
    files = first_lines(lines)
    head = F.regexp_replace(text(F.col("head"), F.col("utf8")), "\r$", "")
    files = materialize(files.select("path", "utf8", separator(head, F.col("n_lines")).alias("sep")), "files")
    value = F.regexp_replace(text(F.col("value"), F.col("utf8")), "\r$", "")
    rows = lines.join(files, "path").select(*_SPLIT, "id", "sep", text(F.col("value"), F.col("utf8")).alias("value"), value.alias("_v"))
    rows = rows.select(*_SPLIT, "id", "sep", "value", (F.col("_v") == "").alias("blank"), _open_after(F.col("_v"), F.col("sep"), False).alias("f0"),
                       _open_after(F.col("_v"), F.col("sep"), True).alias("f1"))
    # Both variants of the state before every line, and of the number of rows begun.
    flip = (F.col("f0") & ~F.col("f1")).cast("int")
    upto = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _inside().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_f", F.sum(flip).over(upto))
    fixed = F.last(F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("e"), "_f")), True).over(before)
    rows = rows.withColumn("_fixed", fixed).withColumn("_so", F.coalesce(F.sum(flip).over(before), F.lit(0)))
    odd = F.when(F.col("_fixed").isNull(), F.col("_so")).otherwise(F.col("_so") - F.col("_fixed._f")) % 2 == 1
    for h in (0, 1):
        rows = rows.withColumn(f"s{h}", F.coalesce(F.col("_fixed.e"), F.lit(bool(h))) != odd)
        rows = rows.withColumn(f"r{h}", F.sum((~F.col(f"s{h}") & ~F.col("blank")).cast("long")).over(upto))
    rows = materialize(rows.drop("_f", "_fixed", "_so"), "quoted")
    after = lambda h: F.when(F.col(f"s{h}"), F.col("f1")).otherwise(F.col("f0"))
    splits = rows.groupBy(*_SPLIT).agg(*[F.max_by(after(h), "id").alias(f"e{h}") for h in (0, 1)], *[F.max(f"r{h}").alias(f"n{h}") for h in (0, 1)])
    splits = _begin_quoted(splits)
    n = F.when(F.col("begin"), F.col("n1")).otherwise(F.col("n0"))
    splits = materialize(splits.select(*_SPLIT, "begin", F.coalesce(F.sum(n).over(_splits_before()), F.lit(0)).alias("off")), "splits")
    pick = lambda x: F.when(F.col("begin"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    rows = rows.join(splits, _SPLIT).withColumn("open", pick("s")).withColumn("rec", F.col("off") + pick("r") - 1)
    rows = rows.withColumn("more", F.when(F.col("open"), F.col("f1")).otherwise(F.col("f0")))
    whole = rows.filter("NOT open AND NOT more AND NOT blank").select("path", "rec", "sep", "value")
    parts = rows.filter("open OR more").groupBy("path", "rec", "sep").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return whole.unionByName(parts).select("path", "rec", fields_of(F.regexp_replace("value", "\r$", ""), F.col("sep")).alias("fields"))


# ------------------------------------------------------------------------ JSON

def _bare(value: Column, quoted: bool) -> Column:
    """A piece without its escapes and the text of its strings, begun inside one (``quoted``) or not."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")
    if quoted:
        plain = F.regexp_replace(plain, r'(?s)^[^"]*+("|$)', "")
    return F.regexp_replace(plain, r'(?s)"[^"]*+("|$)', "")


def _deeper(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^\[{]", "")) - F.length(F.regexp_replace(value, r"[^\]}]", ""))


def _counted(rows: DataFrame, start: Column, out: str) -> DataFrame:
    """``rows`` with the running number of those where ``start`` holds, per file."""
    upto = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(f"_{out}", F.sum(start.cast("long")).over(upto))
    total = rows.groupBy(*_SPLIT).agg(F.max(f"_{out}").alias("_n"))
    off = total.select(*_SPLIT, F.coalesce(F.sum("_n").over(_splits_before()), F.lit(0)).alias("_off"))
    return rows.join(off, _SPLIT).withColumn(out, F.col("_off") + F.col(f"_{out}")).drop("_off", f"_{out}")


def json_items(spark: SparkSession, path: str | list[str], keys: tuple[str, ...] = ("data", "values")) -> DataFrame:
    """(path, item, text): the elements of a JSON list; of an object the elements of the
    list under the first of ``keys`` that has one, else the whole object; else the whole
    text.  One element is put together in one task."""
    rows = pieces(spark, path, ",")
    flip = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', "")) % 2
    before = _inside().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("odd", F.coalesce(F.sum(flip).over(before), F.lit(0)) % 2 == 1).withColumn("flip", flip == 1)
    for h, quoted in ((0, F.col("odd")), (1, ~F.col("odd"))):
        step = F.when(quoted, _deeper(_bare(F.col("value"), True))).otherwise(_deeper(_bare(F.col("value"), False)))
        rows = rows.withColumn(f"step{h}", step.cast("long")).withColumn(f"d{h}", F.coalesce(F.sum(f"step{h}").over(before), F.lit(0)))
    rows = materialize(rows, "json-pieces")
    splits = rows.groupBy(*_SPLIT).agg((F.sum(F.col("flip").cast("int")) % 2 == 1).alias("e0"), F.sum("step0").alias("n0"), F.sum("step1").alias("n1"))
    splits = _begin_quoted(splits.withColumn("e1", ~F.col("e0")))
    n = F.when(F.col("begin"), F.col("n1")).otherwise(F.col("n0"))
    splits = splits.select(*_SPLIT, "begin", F.coalesce(F.sum(n).over(_splits_before()), F.lit(0)).alias("off"))
    pick = lambda x: F.when(F.col("begin"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    rows = rows.join(materialize(splits, "splits"), _SPLIT).select(
        *_SPLIT, "id", "value", (F.col("begin") != F.col("odd")).alias("quoted"), (F.col("off") + pick("d")).alias("depth"), pick("step").alias("step"))
    # A piece outside strings at depth 1 begins a member of the root, one at depth 2 an element below it.
    rows = _counted(rows, ~F.col("quoted") & (F.col("depth") <= 1), "member")
    rows = materialize(_counted(rows, ~F.col("quoted") & (F.col("depth") <= 2), "item"), "json-places")
    roots = rows.groupBy("path").agg(F.min_by(F.substring(F.ltrim(F.regexp_replace("value", r"\s+", " ")), 1, 1), F.struct("block", "id")).alias("root"))
    begins = rows.filter(~F.col("quoted") & (F.col("depth") <= 1))
    named = [F.when(F.regexp_like("value", F.lit(rf'(?s)^\s*\{{?\s*"{k}"\s*:\s*\[')), F.lit(i)) for i, k in enumerate(keys)]
    lists = begins.withColumn("_k", F.coalesce(*named, F.lit(None).cast("int")) if keys else F.lit(None).cast("int")).filter("_k IS NOT NULL").groupBy("path").agg(
        F.min(F.struct("_k", "member")).getField("member").alias("listed"))
    files = roots.join(lists, "path", "left").select("path", F.when(F.col("root") == "[", "list").when(
        (F.col("root") == "{") & F.col("listed").isNotNull(), "member").otherwise("whole").alias("kind"), "listed")
    files = materialize(files, "json-files")
    rows = rows.join(files, "path").filter((F.col("kind") != "member") | (F.col("member") == F.col("listed")))
    item = F.when(F.col("kind") == "list", F.col("member")).when(F.col("kind") == "member", F.col("item")).otherwise(F.lit(0))
    # A list's first element has the text before it, the last one the text after it.
    inner = F.when(F.col("kind") == "list", 1).otherwise(2)
    rows = rows.select("path", "kind", item.alias("item"), "block", "id", "value", (F.col("depth") < inner).alias("first"),
                       (F.col("depth") + F.col("step") < inner).alias("last"))
    got = rows.groupBy("path", "kind", "item").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), ",").alias("text"),
        F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    known, text = F.col("kind"), F.col("text")
    opening = F.when(known == "list", r"(?s)\A\s*\[").otherwise(rf'(?s)\A\s*\{{?\s*"(?:{"|".join(keys)})"\s*:\s*\[')
    closing = F.when(known == "list", r"(?s)\]\s*\z").otherwise(r"(?s)\]\s*(?:\}\s*)?\z")
    text = F.when((known != "whole") & F.col("first"), F.regexp_replace(text, opening, F.lit(""))).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    got = got.withColumn("text", text).withColumn("text", F.trim(F.when(
        (known != "whole") & F.col("last"), F.regexp_replace("text", closing, F.lit(""))).otherwise(F.col("text"))))
    return got.filter("text <> ''").select("path", "item", "text")


def read_json_lines(items: DataFrame) -> DataFrame:
    """The elements of ``json_items`` as rows: objects by their members, anything else as
    the column ``value``.  They are written as one line each, so that Spark's JSON scan,
    which finds the columns, reads them in splits too."""
    import uuid
    spark = items.sparkSession
    if items.isEmpty():
        return spark.createDataFrame([], "value string")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gridscope-json-{uuid.uuid4().hex}"
    remember(folder)
    line = F.when(F.col("text").startswith("{"), F.col("text")).otherwise(F.concat(F.lit('{"value": '), F.col("text"), F.lit("}")))
    items.select(line.alias("value")).write.text(folder)
    return spark.read.json(folder)
