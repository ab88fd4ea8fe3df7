"""Operator 4: personal data by bootstrapped contextual extraction.

Native: DataFrame functions only.

Base kinds (email, ip, card, phone) are found by pattern and checked; quoted long
tokens are further seeds of kind ``secret``.  Every seed and every other
identifier-like string (8 or more characters, 4 or more digits, also in groups
between blanks or colons) is an instance; the words before it, and the words around
it, are its lexical patterns.  The pattern-instance graph is scored in rounds, and
each round induces its patterns anew, from the seeds and the instances accepted so
far: a pattern needs ``MIN_SEEDS`` different ones.  Its score is the share of its
instances' scores in all words that stand in its slot anywhere in the corpus, ordinary
words included (with ``PRIOR`` doubtful ones added); an instance's score is one minus
the product of its patterns' doubts, and seeds stay at 1.  Instances that reach
``ACCEPT`` become spans of kind ``found``; rounds end when scores change no more.

The graph holds (pattern, instance, count) rows; texts are read twice (matches, slots)
and never shuffled.  Words in slots are counted before the shuffle, for patterns only
that seeds can reach through enough shared instances.  Patterns with a large share of the rows are summed before
the shuffle and joined against one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import BROADCAST_ROWS, documents, stored, text_of

ROUNDS = 6
PRIOR = 1.0
MIN_SEEDS = 3
ACCEPT = 0.8
#: Characters on each side that a pattern looks at: part of what a pattern is.
CONTEXT = 60

# Possessive loops and look-behinds only avoid needless retries; matches are those
# of the contract's plain patterns.
_MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"(?<=[\"'])[A-Za-z0-9_+/=-]{24,}+(?=[\"'])"
_GROUPS = r"(?:[0-9A-Fa-f]{2,4}+(?::[0-9A-Fa-f]{2,4}+){2,}+|[0-9]{2,6}+(?:\x20[0-9]{2,6}+)+)(?![A-Za-z0-9_/+.@:-])"
_TOKEN = rf"(?<![A-Za-z0-9_/+.@:-])(?:{_GROUPS}|[A-Za-z_/+.-]*+[0-9][A-Za-z0-9_/+.-]*+)"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "found")
_SPANS = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, before, after>>: non-overlapping matches with
    places in code points and the text around them."""
    # Both arrays are worked out once: everything else reads the lambda's struct.
    both = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))

    def zipped(g):
        n = F.size(g["gaps"])
        return F.arrays_zip(g["gaps"].alias("gap"), g["hits"].alias("hit"), F.slice(g["gaps"], 2, n).alias("next"),
                            F.slice(g["hits"], 2, n).alias("hit2"), F.slice(g["gaps"], 3, n).alias("next2"))

    none = F.array().cast(_SPANS)

    def step(acc, r):
        start = acc["at"] + F.length(r["gap"])
        end = start + F.length(F.coalesce(r["hit"], F.lit("")))
        before = F.right(F.concat(acc["tail"], r["gap"]), F.lit(CONTEXT))
        after = F.left(F.concat_ws("", r["next"], r["hit2"], r["next2"]), F.lit(CONTEXT))
        one = F.struct(start.alias("start"), end.alias("end"), r["hit"].alias("hit"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat_ws("", before, r["hit"]), F.lit(CONTEXT)).alias("tail"),
                        F.when(r["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))
    return F.flatten(F.transform(both, lambda g: F.aggregate(zipped(g), begin, step, lambda a: a["out"])))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    d = F.split(F.reverse(_digits(hit)), "")

    def add(acc, i):
        x = F.get(d, i).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(_digits(hit)) - 1), F.lit(0), add) % 10 == 0


def _small_parts(hit: Column) -> Column:
    def small(p):
        p = F.ltrim(p, F.lit("0"))
        return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))
    return F.forall(F.split(hit, r"\."), small)


def base_spans(text: Column) -> dict[str, Column]:
    """The checked matches of every base kind, and the seeds of kind ``secret``."""
    def when(test, arr):
        return F.when(test, arr).otherwise(F.array().cast(_SPANS))

    n = lambda s: F.length(_digits(s["hit"]))
    return {
        "email": when(F.contains(text, F.lit("@")), spans_of(text, _MAIL)),
        "ip": when(text.rlike(_IP), F.filter(spans_of(text, _IP), lambda s: _small_parts(s["hit"]))),
        "card": when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(
            spans_of(text, _CARD), lambda s: F.when(n(s).between(16, 19), _luhn(s["hit"])).otherwise(False))),
        "phone": when(F.contains(text, F.lit("+")), F.filter(spans_of(text, _PHONE), lambda s: n(s).between(8, 15))),
        "secret": when(text.rlike(_SECRET), F.filter(spans_of(text, _SECRET), lambda s: n(s) >= 6)),
    }


def _others(text: Column) -> Column:
    """Identifier-like strings, ends trimmed of punctuation."""
    def trim(s):
        hit = F.rtrim(s["hit"], F.lit("._/+-"))
        return F.struct(s["start"], (s["start"] + F.length(hit)).alias("end"), hit.alias("hit"), s["before"],
                        F.concat(F.substr(s["hit"], F.length(hit) + 1), s["after"]).alias("after"))
    got = F.transform(spans_of(text, _TOKEN), trim)
    keep = F.filter(got, lambda s: (F.length(s["hit"]) >= 8) & (F.length(_digits(s["hit"])) >= 4))
    return F.when(text.rlike("[0-9]"), keep).otherwise(F.array().cast(_SPANS))


def _plain(c: Column) -> Column:
    """Lower case, numbers as 0, one blank between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "0"), r"\s+", " ")


def _named(left: Column, near: Column, right: Column) -> Column:
    """The two patterns of a place: two words before it; one word on each side."""
    return F.array(F.concat(F.lit("L "), F.right(F.ltrim(left), F.lit(CONTEXT))),
                   F.concat(F.lit("B "), F.right(F.ltrim(near), F.lit(CONTEXT)), F.lit(" _ "), F.left(F.rtrim(right), F.lit(CONTEXT))))


def _patterns(s: Column) -> Column:
    """Lexical patterns of an occurrence; what touches it belongs to the context."""
    before, after = _plain(s["before"]), _plain(s["after"])
    return _named(F.regexp_extract(before, r"((?:\S+ ){0,2}\S*)$", 1), F.regexp_extract(before, r"((?:\S+ )?\S*)$", 1),
                  F.regexp_extract(after, r"^(\S*(?: \S+)?)", 1))


def slots(docs: DataFrame) -> DataFrame:
    """(pattern): both patterns of every word of every text, one row each."""
    w = docs.select(F.filter(F.split(_plain(text_of()), " ", -1), lambda x: x != "").alias("w"))
    none = F.array(F.lit(""))
    w = w.select(F.inline(F.arrays_zip(
        F.concat(none, none, "w").alias("a"), F.concat(none, "w").alias("b"), F.col("w").alias("c"),
        F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), none).alias("d")))).filter("c IS NOT NULL")
    core = r"^(.*[^a-z0-9_/+.@-])?([a-z0-9_/+.@-]*[a-z0-9])([^a-z0-9]*)$"
    lead, trail = F.regexp_extract("c", core, 1), F.regexp_extract("c", core, 3)
    w = w.select(F.concat("a", F.lit(" "), "b", F.lit(" "), lead).alias("left"), F.concat("b", F.lit(" "), lead).alias("near"),
                 F.concat(trail, F.lit(" "), "d").alias("right"))
    return w.select(F.explode(_named(F.col("left"), F.col("near"), F.col("right"))).alias("pattern"))


def spotted(docs: DataFrame) -> DataFrame:
    """(_d, _x, doc_id, one array of spans per base kind and ``secret``, ``other``)."""
    t = docs.select("doc_id", text_of().alias("_t"))
    kinds = base_spans(F.col("_t"))
    t = t.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.xxhash64("_t").alias("_x"),
                 *[c.alias(k) for k, c in kinds.items()], _others(F.col("_t")).alias("other"))
    every = F.concat(*[F.col(k) for k in kinds])
    apart = F.filter("other", lambda o: ~F.exists(every, lambda s: (s["start"] < o["end"]) & (o["start"] < s["end"])))
    return t.withColumn("other", apart)


def _reachable(edges: DataFrame, rounds: int) -> DataFrame:
    """(pattern): those that ``rounds`` rounds induce if every instance they meet is
    accepted; no other pattern ever gets a score."""
    known, last = edges.filter("seed").select("hit").distinct(), None
    for _ in range(rounds):
        patterns = stored(edges.join(known, "hit").groupBy("pattern").count().filter(
            F.col("count") >= MIN_SEEDS).select("pattern"), "patterns-reached")
        if (now := patterns.count()) == last:
            break
        last = now
        known = edges.join(patterns, "pattern").select("hit").unionByName(edges.filter("seed").select("hit")).distinct()
    return patterns


def graph(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, hit, n, seed, words): how often each instance stands in each slot that
    a round can induce, and how many words stand there in all."""
    seeds = F.concat(*[F.col(k) for k in (*BASE, "secret")])
    occ = found.select(F.explode(F.concat(
        F.transform(seeds, lambda s: F.struct(s["hit"].alias("hit"), _patterns(s).alias("p"), F.lit(True).alias("seed"))),
        F.transform("other", lambda s: F.struct(s["hit"].alias("hit"), _patterns(s).alias("p"), F.lit(False).alias("seed"))))).alias("o"))
    edges = stored(occ.select("o.hit", "o.seed", F.explode("o.p").alias("pattern")).groupBy("pattern", "hit").agg(
        F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "pattern-places")
    shared = stored(edges.join(_reachable(edges, rounds), "pattern").groupBy("pattern").agg(F.sum("n").alias("in_graph")), "patterns")
    # Few patterns go to the words, many meet words counted by pattern.
    n = F.count(F.lit(1)).alias("words")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        words = slots(docs).join(F.broadcast(shared.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(n)
    else:
        words = slots(docs).groupBy("pattern").agg(n).join(shared.select("pattern"), "pattern", "left_semi")
    shared = shared.join(words, "pattern", "left").select(
        "pattern", F.greatest("in_graph", F.coalesce("words", F.lit(0))).alias("words"))
    return stored(edges.join(shared, "pattern"), "pattern-graph")


def scored(edges: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(hit, seed, score) after ``rounds`` rounds, or when they change no more."""
    scores = edges.groupBy("hit").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double"))
    last = None
    for _ in range(rounds):
        known = edges.drop("seed").join(scores, "hit")
        p = known.groupBy("pattern", "words").agg(F.count_if(F.col("score") >= accept).alias("k"), F.sum(F.col("n") * F.col("score")).alias("s")).filter(
            F.col("k") >= MIN_SEEDS).select("pattern", (F.col("s") / (F.col("words") + PRIOR)).alias("c"))
        doubt = F.sum(F.log(F.greatest(1.0 - F.coalesce("c", F.lit(0.0)), F.lit(1e-9))))
        fresh = edges.join(p, "pattern", "left").groupBy("hit").agg(F.max("seed").alias("seed"), (1.0 - F.exp(doubt)).alias("s"))
        scores = stored(fresh.select("hit", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("s")).alias("score")), "pattern-scores")
        now = scores.agg(F.count_if(F.col("score") >= accept), F.round(F.sum("score"), 3)).first()
        if now == last:
            break
        last = now
    return scores


def discovered(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(hit, score) of the accepted identifiers outside the seeds."""
    scores = scored(graph(found, docs, rounds), rounds, accept)
    return scores.filter(~F.col("seed") & (F.col("score") >= accept)).select("hit", "score")


def private_data(docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """doc_id and one array of (start, end, hit) per kind, for each row of ``docs``.

    Null and empty texts have empty arrays.  Repeated rows give equal results.
    An empty table gives an empty one; other columns are not read."""
    found = stored(spotted(docs), "private-spots")
    good = discovered(found, docs, rounds, accept)
    more = (found.select("_d", "_x", F.explode("other").alias("o")).withColumn("hit", F.col("o.hit"))
            .join(good, "hit").groupBy("_d", "_x")
            .agg(F.array_sort(F.collect_set(F.struct("o.start", "o.end", "o.hit"))).alias("found")))
    slim = lambda k: F.transform(k, lambda s: F.struct(s["start"], s["end"], s["hit"])).alias(k)
    out = found.join(more, ["_d", "_x"], "left")
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return out.select("doc_id", *[slim(k) for k in (*BASE, "secret")], F.coalesce("found", none).alias("found"))


def _joined(kinds) -> Column:
    """kind:start:end of all spans, kinds in the given order, then by start."""
    def told(kind):
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[told(k) for k in kinds]), ",")


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    out = private_data(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                      F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
