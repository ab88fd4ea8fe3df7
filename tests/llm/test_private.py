import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from gridscope.llm import private

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [None, "", "a@b", "a@b.c_d@e.f x", "é a.b+c@x-y.zz.org, ü", "1.2.3.4.5.6.7.8", "999.1.1.1 000255.0.0.1 256.1.1.1", "4111 1111 1111 1111",
       "4111-1111-1111-1111 4111  1111", "41111111111111112222", "+1 (743) 555-3824 5", "+12 +123456789012345678", "💥 mail me: x@y.zz 💥 a@b.cc",
       "a" * 30000 + "@b.cc", "1" * 30000, "1 " * 20000, "a@" + "b." * 20000 + "c", "+1" + "(" * 20000, "@.@.@", "x@-.-"]


def result(df):
    out = private.private_data(df)
    return out.select("doc_id", *[F.size(k).alias(f"n_{k}") for k in private.BASE],
                      private._joined(private.BASE).alias("base"), private._joined(private.KINDS).alias("spans")).collect()


def test_base_spans(docs_of, sample, with_clashes):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in sample.collect()] + [(None, "i@j.kk"), (3, "q@r.ss"), (3, "q@r.ss")]
    got = result(with_clashes(docs_of(rows)))
    want = sorted(((d, ",".join(base(t))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.base) for r in got), key=str) == want
    for r in got:
        n = Counter(s.split(":")[0] for s in filter(None, r.base.split(",")))
        assert all(n[k] == r[f"n_{k}"] for k in private.BASE)
        assert (r.spans + ",").startswith(r.base + ",") or not r.base


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in private.op4_private_data(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base(texts[r.doc_id])).encode()).hexdigest()


def test_bootstrap_finds_unseen_identifiers(docs_of):
    """Seeds teach the context; an identifier of another shape in it is found,
    one in other contexts is not."""
    rows = [(k, f"lorem word{chr(97 + k % 26)} call us at +1 (743) 555-{3000 + k} today") for k in range(12)]
    rows += [(50, "please call us at 0043-5550-99 today"), (51, "order 20250101x was number 0043-7777-99 of many"), (52, 'a token = "9f86d081884c7d659a2feaa0c55ad015" is')]
    got = {r.doc_id: r.spans for r in result(docs_of(rows))}
    assert got[50] == "found:18:30"
    assert got[51] == ""
    assert got[52].startswith("secret:11:")
    assert result(docs_of([])) == []


def test_chained_bootstrap_and_groups(docs_of):
    """Found identifiers teach their other contexts; groups between blanks or colons are
    found; numbers in slots of ordinary words are not."""
    rows = [(k, f"lorem word{chr(97 + k % 26)} call us at +1 (743) 555-{3000 + k} today") for k in range(12)]
    shapes = ["0043-5550-91", "AB:12:CD:34:EF:56", "1234 5678 9012", "0043-5550-94"]
    rows += [(50 + k, f"please call us at {x} today") for k, x in enumerate(shapes)]
    rows += [(60 + k, f"member card no. {x} expired") for k, x in enumerate(shapes)]
    rows += [(70, "member card no. ZX-777-8888 expired"), (71, "4111 1111 1111 1112 is from that, the 99887766 one")]
    rows += [(80 + k, f"from that, the {w} one") for k, w in enumerate(["first", "last", "red", "20240101", "20240102", "20240103"])]
    got = {r.doc_id: r.spans for r in result(docs_of(rows))}
    for k, x in enumerate(shapes):
        assert got[50 + k] == f"found:18:{18 + len(x)}" and got[60 + k] == f"found:16:{16 + len(x)}"
    assert got[70] == "found:16:27"
    assert all(got[d] == "" for d in (71, *range(80, 86)))


def brute_scores(edges, rounds):
    """The same graph in dictionaries."""
    hits = {e["hit"]: False for e in edges}
    for e in edges:
        hits[e["hit"]] |= e["seed"]
    score = {h: float(s) for h, s in hits.items()}
    for _ in range(rounds):
        conf = {}
        for p in {e["pattern"] for e in edges}:
            mine = [e for e in edges if e["pattern"] == p]
            if sum(score[e["hit"]] >= private.ACCEPT for e in mine) >= private.MIN_SEEDS:
                conf[p] = sum(e["n"] * score[e["hit"]] for e in mine) / (mine[0]["words"] + private.PRIOR)
        fresh = {}
        for h, seed in hits.items():
            doubt = 1.0
            for e in edges:
                if e["hit"] == h:
                    doubt *= max(1 - conf.get(e["pattern"], 0.0), 1e-9)
            fresh[h] = 1.0 if seed else 1 - doubt
        score = fresh
    return score


def words_in_slots(texts):
    """How many words stand in each slot, word by word."""
    out = Counter()
    for t in texts:
        w = re.sub("[0-9]+", "0", (t or "").lower()).split()
        for i, c in enumerate(w):
            m = re.match(r"(.*[^a-z0-9_/+.@-])?([a-z0-9_/+.@-]*[a-z0-9])([^a-z0-9]*)$", c)
            lead, trail = (m[1] or "", m[3]) if m else ("", "")
            a, b, d = w[i - 2] if i > 1 else "", w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
            out["L " + f"{a} {b} {lead}".lstrip(" ")[-60:]] += 1
            out["B " + f"{b} {lead}".lstrip(" ")[-60:] + " _ " + f"{trail} {d}".rstrip(" ")[:60]] += 1
    return out


def test_graph_against_brute_force(docs_of):
    rows = [(k, f"ring ({'+1 743 555-' + str(3000 + k)}), or id=4{k:07d}x now" if k % 3 else f"ring (+1 743 555-{3000 + k}) or id=word now") for k in range(20)]
    rows += [(30 + k, f"ring (8800-{1000 + k}), or id=mail{k}@x.org now and then ring someone") for k in range(6)] + [(40, None), (41, ""), (42, "ring")]
    docs = docs_of(rows)
    edges = private.graph(private.spotted(docs), docs)
    full = [r.asDict() for r in edges.collect()]
    words = words_in_slots(t for _, t in rows)
    most = Counter()
    for e in full:
        most[e["pattern"]] += e["n"]
    assert full and all(e["words"] == max(words[e["pattern"]], most[e["pattern"]]) for e in full)
    assert any(e["words"] > most[e["pattern"]] for e in full)
    for rounds in (1, 2, 4):
        got = {r.hit: r.score for r in private.scored(edges, rounds).collect()}
        want = brute_scores(full, rounds)
        assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-3 for h in got)
