import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.llm import language, topk

LETTERS = re.compile(r"[^\W\d_]+")


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op6_language(spark, sf).collect()
    assert len(got) == len(lang)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out)


def test_language_odd_texts(docs_of, sample, with_clashes):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sample.collect()]
    rows += [(900, None, "en", None), (901, "", None, None), (902, "123 !!", "xx", None), (903, "日本語", None, None), (None, "the", None, None),
             (904, "the of and " * 20000, None, None), (905, "the of and", None, None), (905, "the of and", None, None)]
    got = {r.doc_id: r for r in language.identify(with_clashes(docs_of(rows)), F.lit(True)).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert got[904].lang_pred == got[905].lang_pred == "en"
    assert got[903].lang_pred != "und" and got[903].rejected
    assert not got[0].rejected


def test_language_nothing_to_learn(docs_of):
    assert [r.lang_pred for r in language.identify(docs_of([(1, "text", None, None)]), F.lit(True)).collect()] == ["und"]
    assert language.identify(docs_of([]), F.lit(True)).count() == 0


def kneser_ney(rows, order=4):
    """Interpolated Kneser-Ney from its definition, with dictionaries: a function of
    (word, language) that gives -log2 of the word's probability."""
    langs = sorted({lang for lang, _ in rows if lang is not None and LETTERS.search(_ or "")})
    counts = {x: [None] * (order + 1) for x in langs}
    for x in langs:
        top = Counter()
        for lang, text in rows:
            if lang == x:
                for w in LETTERS.findall((text or "").lower()):
                    w = "\x02" * (order - 1) + w + "\x03"
                    top.update(w[i:i + order] for i in range(len(w) - order + 1))
        counts[x][order] = top
        for n in range(order - 1, 0, -1):
            counts[x][n] = Counter(g[1:] for g in counts[x][n + 1])
    letters = {g for x in langs for g in counts[x][1]}

    def discount(c):
        one, two = (sum(v == k for v in c.values()) for k in (1, 2))
        return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5

    facts = {}
    for x in langs:
        for n in range(1, order + 1):
            total, kinds = Counter(), Counter()
            for g, v in counts[x][n].items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            facts[x, n] = discount(counts[x][n]), total, kinds

    def p(g, x):
        if not g:
            return 1.0 / max(2, len(letters))
        d, total, kinds = facts[x, len(g)]
        ctx = g[:-1]
        if not total[ctx]:
            return p(g[1:], x)
        seen = counts[x][len(g)][g]
        return (max(seen - d, 0) if seen else 0) / total[ctx] + d * kinds[ctx] / total[ctx] * p(g[1:], x)

    def cost(word, x):
        w = "\x02" * (order - 1) + word + "\x03"
        return -sum(math.log2(max(p(w[i:i + order], x), 1e-12)) for i in range(len(w) - order + 1))

    return langs, cost


def test_probabilities_of_a_context_sum_to_one(docs_of):
    _, cost = kneser_ney([("x", "abab abba baab"), ("x", "cab bac")])
    langs, orders = language.tables(docs_of([(1, "abab abba baab", "x"), (2, "cab bac", "x")]).select("lang", "text"))
    grams = docs_of([(1, "", "")]).sparkSession.createDataFrame([("aba" + c,) for c in "abc\x03"] + [("\x02\x02\x02" + c,) for c in "abc\x03"], "gram string")
    got = {r.gram: r.p[0] for r in language.probabilities(grams, langs, orders).collect()}
    for ctx in ("aba", "\x02\x02\x02"):
        assert sum(p for g, p in got.items() if g.startswith(ctx)) == pytest.approx(1.0, abs=1e-9)
    assert cost("ab", "x") > 0


def test_no_gram_is_left_out(docs_of, monkeypatch):
    r = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    many = [" ".join("".join(w) for w in letters[r.integers(0, 26, (60_000, 6))]) for _ in range(8)]
    rare = "quick brown foxes jump over lazy dogs"
    docs = docs_of([(k, t, "hot") for k, t in enumerate(many)] + [(90, rare, "rare")])
    langs, orders = language.tables(docs.select("lang", "text"))
    grams = {("\x02\x02\x02" + w + "\x03")[i:i + 4] for t in [*many, rare] for w in set(t.split()) for i in range(len(w) + 1)}
    assert len(grams) > 400_000
    table, n = language.shards(orders[3], 4, langs)
    sizes = [len(x.grams) // 8 for x in table.select("grams").collect()]
    assert n > 1 and len(sizes) == n and sum(sizes) == len(grams)
    keys = np.concatenate([np.frombuffer(x.grams, "<u8") for x in table.select("grams").collect()])
    assert len(np.unique(keys)) == len(grams)


@pytest.mark.parametrize("block_chars, most", [(1, 200_000), (3_000, 50), (4_000_000, 700)])
def test_scores_equal_the_definition(docs_of, sample, monkeypatch, block_chars, most):
    """Against dictionaries, for every size of block and shard."""
    monkeypatch.setattr(language.shards, "__defaults__", (most,))
    rows = [(r.doc_id, r.text, r.lang) for r in sample.limit(60).collect()] + [
        (900, None, None), (901, "", None), (902, "12", "xx"), (903, "日本語 \U0001d400é", None), (904, "日本 ж", "ja")]
    docs = docs_of(rows)
    langs, orders = language.tables(docs.filter("lang IS NOT NULL AND doc_id % 2 = 0").select("lang", "text"))
    known, cost = kneser_ney([(r[2], r[1]) for r in rows if r[2] is not None and r[0] % 2 == 0])
    assert known == langs
    each = functools.cache(cost)
    got = language.scored(docs.select("doc_id", "text"), langs, orders, block_chars).collect()
    assert sorted(x.doc_id for x in got) == sorted(x[0] for x in rows)
    texts = {x[0]: LETTERS.findall((x[1] or "").lower()) for x in rows}
    for x in got:
        words = texts[x.doc_id]
        if not words:
            assert x.h is None
            continue
        size = sum(map(len, words)) + len(words)
        assert np.allclose(x.h, [sum(each(w, lang) for w in words) / size for lang in langs], rtol=1e-9)


def test_rare_languages_reject_too(docs_of):
    rows = [(k, f"common words of text {k} here", "en") for k in range(300)] + [(900 + k, "жук лук сук", "ru") for k in range(3)]
    rows += [(1000, "щщъ ыыъэ ююя", None)]
    got = {r.doc_id: r for r in language.identify(docs_of(rows), F.col("doc_id") < 1000).collect()}
    assert got[901].lang_pred == "ru" and not got[901].rejected and got[1000].rejected


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, k, every):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in rows), default=0)
    ids = np.array([i for i, _ in rows])
    m = np.zeros((len(rows), dim), np.int64)
    for n, (_, v) in enumerate(rows):
        m[n, :len(v)] = np.floor(64 * np.asarray(v, np.float32).astype(np.float64))
    out = []
    for n in range(len(rows)):
        if ids[n] % every == 0:
            s = m @ m[n]
            o = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out += [(int(ids[n]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(o)]
    return sorted(out)


@pytest.mark.parametrize("part,page", [(32768, 512), (200, 16)])
def test_top_k_equals_brute_force(spark, monkeypatch, part, page):
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk.Tree.__init__, "__defaults__", (page, 4))
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.2 * r.normal(size=12)]) for i in range(900)]
    rows += [(900 + i, [0.5] * 12) for i in range(40)]  # equal vectors: ties
    rows += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (None, [1.0] * 12), (1004, []), (1020, [0.1] * 3)]
    rows += [(1040, [0.0] * 12), (17, [9.0] * 12), (17, [9.0] * 12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("uid", F.lit(1)).withColumn("region", F.lit(1)).repartition(5)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20, 20)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 20).collect()] == [(0, 1, 1, 2048)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 5).count() == 0
