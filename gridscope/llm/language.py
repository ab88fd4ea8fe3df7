"""Operator 6: language identification with interpolated Kneser-Ney character models.

Spark counts character n-grams per language over every learning document (words
are counted per task first, then their n-grams), derives the continuation counts
of the lower orders and the discounts.  Each order of the model is a stored table of
shards, rows of sorted 64-bit hash arrays with a value per language beside each hash;
all n-grams are kept, and no task or driver holds more than a shard.

Documents are held as blocks of ``BLOCK_CHARS`` with the distinct n-grams of the
highest order in each.  The distinct n-grams of all blocks go to the shards, lowest
order first, are looked up by binary search, and their probabilities go back to the blocks.  The language with the lowest cross-entropy per character wins.  A bounded sample of learning
documents of each language (``CALIBRATION_ROWS``) fixes the temperature of the score and, per
language, the cross-entropy above which a text is marked ``rejected``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import documents, lean, stored

ORDER = 4
#: Characters of documents in a block.
BLOCK_CHARS = 16_000_000
#: N-grams of a shard of the model, about.
SHARD_GRAMS = 200_000
#: Rows a language, about, that fix the score and the rejection.
CALIBRATION_ROWS = 500
#: Distinct words that a task counts before it hands their n-grams on.
WORDS_HELD = 200_000
NO_LANGUAGE = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _padded(word: str) -> str:
    return _START * (ORDER - 1) + word + _END


def _count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of the highest order, counted per task."""
    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            langs, grams, counts = [], [], []
            for lang, words in held.items():
                got: Counter = Counter()
                for w, n in words.items():
                    w = _padded(w)
                    for i in range(len(w) - ORDER + 1):
                        got[w[i:i + ORDER]] += n
                langs += [lang] * len(got)
                grams += got.keys()
                counts += got.values()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()),
                                               pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(lang, Counter()).update(_LETTERS.findall((text.as_py() or "").lower()))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield out()
        yield out()

    return rows.select("lang", "text").mapInArrow(lean(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def tables(rows: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """From (lang, text) rows: languages, and per order the n-grams with their share
    (``v``), context and the context's back-off weight (``w``) per language."""
    level = stored(_count_grams(rows.filter("lang IS NOT NULL")), "grams")
    langs = sorted(r[0] for r in level.select("lang").distinct().collect())
    orders: list[DataFrame] = []
    for order in range(ORDER, 0, -1) if langs else ():
        if order < ORDER:  # continuation counts: in how many types a gram ends
            level = stored(level.groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
        few = {r["lang"]: (r["one"], r["two"]) for r in level.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        discount = {x: min(0.9, max(0.1, a / (a + 2 * b))) if a else 0.5 for x, (a, b) in few.items()}
        d = F.create_map(*[F.lit(v) for x in langs for v in (x, discount.get(x, 0.5))])[F.col("lang")]
        ctx = F.substring("gram", 1, order - 1) if order > 1 else F.lit("")
        t = level.withColumn("ctx", ctx).withColumn("d", d)
        total = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        t = t.join(total, ["lang", "ctx"])
        orders.insert(0, stored(t.select("lang", "gram", "ctx", ((F.col("n") - F.col("d")) / F.col("total")).alias("v"),
                                         (F.col("d") * F.col("kinds") / F.col("total")).alias("w")), "grams"))
    return langs, orders


def _hash(chars: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(chars), 1469598103934665603, np.uint64)
    for k in range(chars.shape[1]):
        h = (h ^ chars[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(grams, width: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, width) if width else np.zeros((len(grams), 0), "<u4")


def _sorted(hashes: np.ndarray, lang: np.ndarray, values: np.ndarray, width: int, missing: float) -> tuple[bytes, bytes]:
    """Sorted distinct hashes, and beside each a value per language."""
    keys, at = np.unique(hashes, return_inverse=True)
    table = np.full((len(keys), width), missing)
    table[at, lang] = values
    return keys.astype("<u8").tobytes(), table.astype("<f8").tobytes()


def _found(keys: bytes, table: bytes, hashes: np.ndarray, width: int, missing: float) -> np.ndarray:
    """The values of hashes by binary search, ``missing`` for unknown ones."""
    keys, table = np.frombuffer(keys, "<u8"), np.frombuffer(table, "<f8").reshape(-1, width)
    if not len(keys):
        return np.full((len(hashes), width), missing)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[at] == hashes)[:, None], table[at], missing)


def _shard(order: int, n: int) -> Column:
    """N-grams of one context share a shard; letters alone are all in one."""
    return F.pmod(F.xxhash64(F.substring("gram", 1, order - 1)), F.lit(n)) if order > 1 else F.lit(0).cast("long")


def shards(t: DataFrame, order: int, langs: list[str], most: int = SHARD_GRAMS) -> tuple[DataFrame, int]:
    """One order of the model as rows of sorted hash arrays: n-grams with their shares,
    contexts with their back-off weights, a value per language each; and their number."""
    at, width = {x: k for k, x in enumerate(langs)}, len(langs)

    def build(key, rows):
        lang = np.array([at[x] for x in rows.column("lang").to_pylist()], np.int64)
        grams = _hash(_codes(rows.column("gram").to_pylist(), order))
        contexts = _hash(_codes(rows.column("ctx").to_pylist(), order - 1)) if order > 1 else np.full(len(grams), _hash(np.zeros((1, 0), "<u4"))[0])
        parts = [*_sorted(grams, lang, rows.column("v").to_numpy(), width, 0.0), *_sorted(contexts, lang, rows.column("w").to_numpy(), width, 1.0)]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), **{k: pa.array([x], pa.binary()) for k, x in zip(_ARRAYS, parts, strict=True)}})

    n = -(-t.count() // most) if order > 1 else 1
    rows = t.withColumn("shard", _shard(order, n))
    schema = "shard long, " + ", ".join(f"{k} binary" for k in _ARRAYS)
    return stored(rows.groupBy("shard").applyInArrow(build, schema), "model-shards"), n


_ARRAYS = ("grams", "shares", "contexts", "weights")


def _lookup(order: int, width: int):
    """Shares and weights of the asked n-grams of one shard, by binary search."""
    def look(key, asked, model):
        chars = _codes(asked.column("gram").to_pylist(), order)
        v, w = np.zeros((len(chars), width)), np.ones((len(chars), width))
        for r in model.to_pylist():  # one row, or none
            v = _found(r["grams"], r["shares"], _hash(chars), width, 0.0)
            w = _found(r["contexts"], r["weights"], _hash(chars[:, :-1]), width, 1.0)
        return pa.table({"gram": asked.column("gram"), "v": pa.array(list(v), pa.list_(pa.float64())), "w": pa.array(list(w), pa.list_(pa.float64()))})

    return look


def probabilities(grams: DataFrame, langs: list[str], orders: list[DataFrame]) -> DataFrame:
    """(gram, p: a probability per language) for distinct grams of the highest order:
    the n-grams of each order meet the shard of their context, where shares and
    weights are looked up by binary search, then the order below."""
    width = len(langs)
    least = 1.0 / max(2, orders[0].select("gram").distinct().count())
    p = None
    for order, t in enumerate(orders, 1):
        table, n = shards(t, order, langs)
        asked = grams.select(F.substring("gram", ORDER - order + 1, order).alias("gram")).distinct().withColumn("shard", _shard(order, n))
        at = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(_lookup(order, width), "gram string, v array<double>, w array<double>")
        if p is None:
            at = at.withColumn("p", F.array_repeat(F.lit(least), width))
        else:
            at = at.withColumn("low", F.substring("gram", 2, order - 1)).join(p.withColumnRenamed("gram", "low"), "low")
        p = at.select("gram", F.zip_with("v", F.zip_with("w", "p", lambda w, x: w * x), lambda v, x: v + x).alias("p"))
    return p


def _word_grams(words: list[str]):
    """Distinct grams of the highest order as code points, and per word the places
    of its grams among them: all places, and how many each word has."""
    padded = [_padded(w) for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    starts = np.cumsum(lengths) - lengths
    n = lengths - ORDER + 1
    first = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    grams = np.lib.stride_tricks.sliding_window_view(chars, ORDER)[first]
    _, one, back = np.unique(_hash(grams), return_index=True, return_inverse=True)
    return grams[one], back, n


def _summed(p: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
    costs = -np.log2(np.maximum(p, 1e-12))[back]
    return np.add.reduceat(costs, np.cumsum(n) - n, axis=0)


def _numbered(texts: list[str | None], known: dict[str, int]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Per text the numbers of its words (new ones join ``known``), their count and
    the characters with word ends."""
    numbers, ends, chars = [], [], []
    for t in texts:
        words = _LETTERS.findall((t or "").lower())
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        ends.append(len(words))
        chars.append(sum(map(len, words)) + len(words))
    return numbers, ends, chars


def _means(each: np.ndarray, numbers: np.ndarray, ends: np.ndarray, chars: np.ndarray, freqs: np.ndarray | None = None) -> np.ndarray:
    out = np.full((len(ends), each.shape[1]), np.nan)
    hi = np.cumsum(ends)
    some = ends > 0
    all_ = each[numbers] if freqs is None else each[numbers] * freqs[:, None]
    sums = np.add.reduceat(all_, (hi - ends)[some], axis=0) if some.any() else each[:0]
    out[some] = sums / chars[some, None]
    return out


def _blocks(rows: DataFrame, block_chars: int) -> DataFrame:
    """Blocks of ``rows`` (``text`` last): the other columns as arrays, the distinct
    grams, and compressed how texts are made of words and words of grams."""
    kept = rows.dtypes[:-1]

    def run(batches):
        block = (TaskContext.get().partitionId() << 33) - 1
        held, known, parts, size = [[] for _ in kept], {}, ([], [], []), 0

        def closed():
            grams, back, n = _word_grams(list(known)) if known else (np.zeros((0, ORDER), "<u4"), *[np.zeros(0, np.int64)] * 2)
            joined = grams.astype("<u4").tobytes().decode("utf-32-le")
            # Numbers as steps, which stay small; a first one counts from 0.
            each = [np.unique(x, return_counts=True) for x in parts[0]]
            steps = np.concatenate([np.diff(x, prepend=np.int32(0)) for x, _ in each])
            data = np.concatenate([np.asarray(x, np.int32) for x in (
                [len(n), len(back), len(steps), len(steps)], n, back, steps, *(f for _, f in each), [len(x) for x, _ in each], parts[2])])
            return pa.RecordBatch.from_arrays([
                pa.array([block]), *(pa.ListArray.from_arrays([0, sum(map(len, h))], pa.concat_arrays(h)) for h in held),
                pa.array([[joined[k:k + ORDER] for k in range(0, len(joined), ORDER)]], pa.list_(pa.string())),
                pa.array([zstandard.compress(data.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary())],
                names=["block", *(c for c, _ in kept), "grams", "data"])

        for b in batches:
            column, start = b.column(b.num_columns - 1), 0
            while start < b.num_rows:
                texts = []
                while start + len(texts) < b.num_rows and size < block_chars:
                    texts.append(column[start + len(texts)].as_py())
                    size += len(texts[-1] or "")
                for h, k in zip(held, range(len(kept)), strict=True):
                    h.append(b.column(k).slice(start, len(texts)))
                for all_, new in zip(parts, _numbered(texts, known), strict=True):
                    all_.extend(new)
                start += len(texts)
                if size >= block_chars:
                    block += 1
                    yield closed()
                    held, known, parts, size = [[] for _ in kept], {}, ([], [], []), 0
        if held and held[0]:
            block += 1
            yield closed()

    fields = ", ".join(f"`{c}` array<{x}>" for c, x in kept)
    return rows.mapInArrow(lean(run), f"block long, {fields}, grams array<string>, data binary")


def scored(rows: DataFrame, langs: list[str], orders: list[DataFrame], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns before ``text``, and ``h``: bits per character in each language,
    null without letters."""
    kept = rows.dtypes[:-1]
    blocks = stored(_blocks(rows, block_chars), "language-blocks")
    grams = stored(blocks.select(F.explode("grams").alias("gram")).distinct(), "asked-grams")
    p = stored(probabilities(grams, langs, orders), "gram-probabilities")
    got = blocks.select("block", F.posexplode("grams").alias("code", "gram")).join(p, "gram").groupBy("block").agg(
        F.collect_list(F.struct("code", "p")).alias("got"))
    both = blocks.drop("grams").join(got, "block", "left")
    names, width = [c for c, _ in kept], len(langs)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = np.frombuffer(zstandard.decompress(b.column("data")[i].as_py()), np.uint8)
                data = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()
                n, back, steps, freqs, rest = np.split(data[4:], np.cumsum(data[:4]))
                columns = [b.column(c)[i].values for c in names]
                h = np.full((len(rest) // 2, width), np.nan)
                if len(n):
                    found = b.column("got")[i].values
                    p = np.zeros((len(found), width))
                    p[found.field("code").to_numpy()] = found.field("p").flatten().to_numpy().reshape(-1, width)
                    ends, chars = np.split(rest, 2)
                    upto = np.cumsum(steps)
                    numbers = upto - np.repeat(np.concatenate([[0], upto])[np.cumsum(ends) - ends], ends)
                    h = _means(_summed(p, back, n), numbers, ends, chars, freqs)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(
                    [None if np.isnan(x[0]) else list(x) for x in h], pa.list_(pa.float64()))], names=[*names, "h"])

    return both.mapInArrow(lean(run, 1), ", ".join(f"`{c}` {x}" for c, x in kept) + ", h array<double>")


def _posterior(h: np.ndarray, tau: float) -> np.ndarray:
    z = np.exp(-tau * (h - h.min(axis=1, keepdims=True)))
    return z / z.sum(axis=1, keepdims=True)


def calibrate(rows: DataFrame, model: dict, most: int = CALIBRATION_ROWS) -> None:
    """Fix ``tau`` and the rejection thresholds on a reproducible sample of about
    ``most`` scored learning rows a language (doc_id, lang, h).  A language with fewer
    than five of them rejects by the sample of all."""
    langs = model["langs"]
    share = {r["lang"]: int(1_000_000 * min(1.0, most / r["n"])) + 1 for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)]) if share else F.create_map(F.lit(""), F.lit(0))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < drawn[F.col("lang")])
    model |= {"tau": 20.0, "reject": [float("inf")] * len(langs)}
    got = rows.select("lang", "h").limit(4 * most * max(1, len(langs))).toPandas()
    got = got[got["h"].map(lambda h: h is not None)]
    if not len(got):
        return
    h = np.stack(got["h"].to_numpy())
    true = got["lang"].map({x: k for k, x in enumerate(model["langs"])}).to_numpy()
    losses = {t: -np.log(np.maximum(_posterior(h, t)[np.arange(len(h)), true], 1e-9)).mean() for t in (1, 2, 4, 8, 12, 16, 24, 32, 48)}
    model["tau"] = float(min(losses, key=losses.get))
    every = h[np.arange(len(h)), true]
    for k in range(len(langs)):
        own = every[true == k]
        model["reject"][k] = float(np.quantile(own if len(own) >= 5 else every, 0.995) + 0.5)


def _predicted(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) from (doc_id, h)."""
    width = len(model["langs"])

    def run(batches):
        for b in batches:
            some = ~np.asarray(b.column(1).is_null())
            best, score, rejected = np.zeros(len(some), np.int64), np.zeros(len(some)), ~some
            if some.any():
                h = b.column(1).drop_null().flatten().to_numpy().reshape(-1, width)
                best[some] = np.argmin(h, axis=1)
                score[some] = _posterior(h, model["tau"]).max(axis=1)
                rejected[some] = h.min(axis=1) > np.asarray(model["reject"])[best[some]]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([model["langs"][k] if s else NO_LANGUAGE for k, s in zip(best, some, strict=True)], pa.string()),
                pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``; the model
    is learnt from the rows for which ``learn`` holds and ``lang`` is not null.

    Null texts and texts without letters are ``und`` with score 0 and rejected;
    so is everything when nothing can be learnt.  Repeated rows are predicted
    alike.  An empty table gives an empty one; other columns are not read."""
    rows = docs.filter(learn & F.col("lang").isNotNull())
    langs, orders = tables(rows.select("lang", "text"))
    if not langs:
        return docs.select("doc_id", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    ask = docs.select("doc_id", "lang", F.coalesce(learn, F.lit(False)).alias("learnt"), "text")
    costs = stored(scored(ask, langs, orders), "language-costs")
    model = {"langs": langs}
    calibrate(costs.filter("learnt AND lang IS NOT NULL"), model)
    return _predicted(costs.select("doc_id", "h"), model)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from two thirds of them."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = identify(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
