import re
from collections import Counter, defaultdict

from gridscope.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


ODD = [None, "", " \n\x0b", "a b c a b c a b c", "x\n\nx\n x\nx", "é ü   z", "a|b #1 <i> $%&*", "one two"]


def test_base_rules(docs_of, sample, with_clashes):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in sample.collect()] + [(None, "x"), (3, "a b"), (3, "a b")]
    got = quality.judged(with_clashes(docs_of(rows)), with_text=False).collect()
    want = sorted(((d, *base(t)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)


def test_line_rules():
    good = ["A plain sentence ends here.", "", "Thing.", "Is this one fine?", "The NASA and ESA met in Paris on Monday for talks.",
            "A heading without a stop", "It costs $5 & more than 100% of that, he said to them."]
    assert [quality.line_fault(x.encode()) for x in good] == [None] * len(good)
    bad = {"home | about | contact | help": "navigation", "Of%%% that&&& is*** bad$$$ now###": "symbols", "BUY!! THIS!! NOW!!": "shouting",
           "All rights reserved.": "boilerplate", "spam spam spam spam spam spam spam spam spam spam": "stutter", "more": "fragment"}
    assert {x: quality.line_fault(x.encode()) for x in bad} == bad


def test_clean_keeps_clean_and_rejects_clutter(docs_of, with_clashes):
    fine = " ".join(f"word{k} stands here." for k in range(40))
    clutter = "\n".join(" ".join(f"w{k}{j}%%% *** |" for j in range(5)) for k in range(20)) + "\nend."
    rows = [(1, fine), (2, fine + "\nAll rights reserved."), (3, clutter), (4, None)]
    df = with_clashes(docs_of(rows))
    got = quality.clean(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: fine, 2: fine}
    assert quality.clean(docs_of([])).count() == 0
    # Columns with the names of the operator's figures keep their values and types.
    own = df.selectExpr("*", "'mine' AS base_failed", "doc_id * 10 AS word_chars", "'b' AS `a.b`")
    out = quality.clean(own)
    assert out.dtypes == own.dtypes
    for r in out.collect():
        assert (r["kept"], r["n_words"], r["base_failed"], r["word_chars"], r["_row"], r["a.b"]) == (7, 7, "mine", 10 * r["doc_id"], 7, "b")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def test_mixing_targets_and_takes(spark, sample, with_clashes, docs_of, tmp_path):
    rows = [(r.doc_id, r.text, "en", r.source) for r in sample.collect()] + [(900, None, "en", "b"), (901, "a b", "en", None), (902, " ", "en", "empty")]
    rows += [(1000 + k, "hot words " * (k % 9), "en", "hot") for k in range(150)] + [(None, "no id here", "en", "hot")] * 2
    path = str(tmp_path / "documents.parquet")
    with_clashes(docs_of(rows)).write.parquet(path)
    got = mixing.op8_mixing(spark, str(tmp_path)).collect()
    again = mixing.op8_mixing(spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.taken <= 2 * r.size
        taken[s] += r.taken
        target[s] = r.target
    want = targets(sizes)
    longest = max(r.size for r in got)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= longest
    mixed = mixing.mix(spark.read.parquet(path))
    assert mixed.columns == spark.read.parquet(path).columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert sum(copies[r.doc_id] for r in got if r.doc_id is not None) == sum(r.copies for r in got if r.doc_id is not None) - sum(
        r.copies for r in got if r.size == 0 and r.doc_id is not None)


def test_mixing_weighted_prefers_heavy_rows(spark, docs_of):
    from pyspark.sql import functions as F
    df = docs_of([(k, "ten words " * 5, "en", "s" if k < 400 else "t") for k in range(800)]).withColumn(
        "quality", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    n = Counter(r.quality for r in mixing.mix(df, weight="quality", share=0.5).collect())
    assert n[3.0] > 2 * n[1.0]


def test_mixing_empty(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
