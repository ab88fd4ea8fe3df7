"""Operator 3: line-first quality rules.

Every line is judged on its own (symbol clutter, navigation, shouting, stuttering,
boilerplate, stray fragments); failing lines are removed; a document that loses
more than ``MAX_LOSS`` of its visible characters, or fails the base rules, is
rejected.  One narrow pass over the documents: no shuffle, a task holds one Arrow
batch.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.llm.common import documents, lean

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS = 0.5

SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under the", "released under the", "this work is licensed",
    "terms of service", "terms of use", "privacy policy", "cookie policy", "use of cookies",
    "lorem ipsum", "enable javascript", "sign up for our newsletter",
)
_ENDS = (b".", b"!", b"?", b":", b";", b"\"", b"'", b")", b"]", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb")
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_LOUD = re.compile(rb"!!")


def line_fault(line: bytes) -> str | None:
    """The first rule that a line breaks; ``None`` for a good or blank line."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if 5 * len(_SYMBOL.findall(line)) >= 2 * n and n >= 3:
        return "navigation" if line.count(b"|") * 3 >= n else "symbols"
    if 3 * len(_LOUD.findall(line)) >= n:
        return "shouting"
    low = line.lower()
    if n <= 30 and any(p in low for p in _BOILER):
        return "boilerplate"
    if n >= 8:
        letters = line.decode("utf-8")
        upper, lower = sum(map(str.isupper, letters)), sum(map(str.islower, letters))
        if upper >= 20 and upper > 4 * lower:
            return "shouting"
        if 5 * len(set(words)) <= n:
            return "stutter"
    if n <= 2 and not words[-1].endswith(_ENDS) and len(line) < 40:
        return "fragment"
    return None


_BOILER = tuple(p.encode() for p in BOILERPLATE)


def base_rules(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = raw.split()  # bytes split on exactly \x20 and \x09-\x0D
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= twice
            repeated = int(covered.sum())
    return (n, len(b"".join(words).decode("utf-8")), len(_SYMBOL.findall(raw)),
            len(lines) - len(set(lines)), repeated)


def judge(text: str | None, max_loss: float = MAX_LOSS) -> dict:
    """Base figures, the text without its failing lines, and the verdict."""
    raw = (text or "").encode("utf-8")
    n, chars, symbols, dups, repeats = base_rules(raw)
    kept, lost, total, failed = [], 0, 0, 0
    for line in raw.split(b"\n"):
        size = len(line.strip())
        total += size
        if line_fault(line) is None:
            kept.append(line)
        else:
            lost += size
            failed += 1
    bad = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    loss = lost / total if total else 0.0
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats,
            "base_failed": bad, "kept": not bad and loss <= max_loss, "n_failed_lines": failed, "lost_share": loss,
            "clean_text": b"\n".join(kept).decode("utf-8") if failed else (text or "")}


_FIELDS = [("n_words", T.LongType(), pa.int64()), ("word_chars", T.LongType(), pa.int64()),
           ("n_symbols", T.LongType(), pa.int64()), ("n_dup_lines", T.LongType(), pa.int64()),
           ("n_repeat_words", T.LongType(), pa.int64()), ("base_failed", T.BooleanType(), pa.bool_()),
           ("kept", T.BooleanType(), pa.bool_()), ("n_failed_lines", T.LongType(), pa.int64()),
           ("lost_share", T.DoubleType(), pa.float64()), ("clean_text", T.StringType(), pa.string())]


def judged(docs: DataFrame, max_loss: float = MAX_LOSS, with_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``judge`` (existing columns of those names
    give way; everything else is carried along).

    Null and empty texts have zero words and fail the base rules.  Repeated rows
    are judged alike.  An empty table gives an empty one."""
    fields = [f for f in _FIELDS if with_text or f[0] != "clean_text"]
    names = {f[0] for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in names and (with_text or f.name != "text")]
    text_at = docs.columns.index("text")
    places = [docs.columns.index(f.name) for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches):
        for b in batches:
            rows = [judge(t, max_loss) for t in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in places] + [pa.array([r[n] for r in rows], t) for n, _, t in fields],
                names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that pass, their failing lines removed; same columns, those of
    any other name unchanged."""
    others = [c for c in docs.columns if c != "text"]
    # The other columns travel in one struct, whatever their names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None)]).alias("_row"), "text")
    out = judged(rows, max_loss).filter("kept")
    return out.select(*[out["clean_text"].alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict for every document."""
    return judged(documents(spark, sf_dir, "doc_id", "text"), with_text=False)


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
base AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
           - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines FROM w),
win AS (SELECT r, i, list_slice(ws, i, i + 2) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
ln AS (SELECT r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS lw, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(ls) AS x FROM w)),
bad AS (
  SELECT r, strlen(regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')) AS size, n > 0 AND (
    (n >= 3 AND 5 * len(regexp_extract_all(x, '[#*$%&|<>]')) >= 2 * n)
    OR 3 * len(regexp_extract_all(x, '!!')) >= n
    OR (n <= 30 AND regexp_matches(lower(x), 'BOILER'))
    OR (n >= 8 AND len(regexp_extract_all(x, '\p{Lu}')) >= 20 AND len(regexp_extract_all(x, '\p{Lu}')) > 4 * len(regexp_extract_all(x, '\p{Ll}')))
    OR (n >= 8 AND 5 * len(list_distinct(lw)) <= n)
    OR (n <= 2 AND strlen(x) < 40 AND NOT regexp_matches(lw[-1], '[.!?:;"'')\]…”»]$'))) AS f FROM ln),
loss AS (SELECT r, count(*) FILTER (WHERE f) AS n_failed_lines, coalesce(sum(size) FILTER (WHERE f), 0) AS lost, sum(size) AS total FROM bad GROUP BY r),
j AS (
  SELECT base.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_failed_lines::BIGINT AS n_failed_lines,
         CASE WHEN total > 0 THEN lost::DOUBLE / total::DOUBLE ELSE 0.0 END AS lost_share
  FROM base JOIN loss USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.5 AS kept, n_failed_lines, lost_share FROM j
""".replace("BOILER", "|".join(BOILERPLATE))
