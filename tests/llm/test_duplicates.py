import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from gridscope.llm import lines, minhash, substrings

M64 = 2 ** 64 - 1


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


# --- line dedup -----------------------------------------------------------


def chunks(text):
    """Chunks by the same rule, from the hash library."""
    ls = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ls]
    most = 2 ** 63 - 1
    r = [most] + [signed(xxhash.xxh64_intdigest(h[i - 1].to_bytes(8, "little"), xxhash.xxh64_intdigest(h[i].to_bytes(8, "little"), 42)))
                  for i in range(1, len(ls))] + [most]
    out, now = [], [ls[0]]
    for i in range(1, len(ls)):
        if r[i] < r[i - 1] and r[i] <= r[i + 1]:
            out.append(now)
            now = []
        now.append(ls[i])
    return [*out, now]


def signed(x):
    return x - 2 ** 64 if x >> 63 else x


def without_repeats(rows):
    seen, out = {}, {}
    keys = sorted({(d, t) for d, t in rows if t is not None},
                  key=lambda r: (r[0], (xxhash.xxh64_intdigest(r[1].encode(), 42) + 2 ** 63) & M64))
    for d, t in keys:
        kept = []
        for c in chunks(t):
            body = "\n".join(c)
            if len(c) >= 2 and body.strip(" ") and body in seen:
                continue
            if len(c) >= 2:
                seen[body] = d
            kept.append(body)
        out[d, t] = "\n".join(kept)
    return [(d, out.get((d, t))) for d, t in rows]


def test_line_dedup_equals_brute_force(docs_of, sample, with_clashes):
    shared = ["\n".join(" ".join(words(6, 10 * s + k)) for k in range(9)) for s in range(4)]
    rows = [(k, "\n".join([" ".join(words(5, 900 + k)), shared[k % 4], " ".join(words(5, 700 + k))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "one line"), (104, shared[0] + "\n" + shared[0]), (5, rows[5][1]), (104, "other text")]
    rows += [(1000 + r.doc_id, r.text) for r in sample.collect()]
    df = with_clashes(docs_of(rows))
    got = lines.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(without_repeats(rows), key=str)
    assert sum(len(t or "") for _, t in without_repeats(rows[:40])) < 0.7 * sum(len(t) for _, t in rows[:40])


def test_line_dedup_empty_and_null_ids(docs_of):
    assert lines.dedup_lines(docs_of([])).count() == 0
    body = "\n".join(" ".join(words(4, k)) for k in range(12))
    got = lines.dedup_lines(docs_of([(None, body), (3, "x\n" + body)])).collect()
    assert {r.text for r in got if r.doc_id is None} == {body}


def without_runs(rows, run=2):
    """Lines left when every run of ``run`` lines that stands earlier is removed."""
    keys = sorted({(d, t) for d, t in rows if t is not None},
                  key=lambda r: (r[0], (xxhash.xxh64_intdigest(r[1].encode(), 42) + 2 ** 63) & M64))
    first, out = {}, {}
    for d, t in keys:
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - run + 1):
            body = "\n".join(ls[i:i + run])
            if any(x.strip(" ") for x in ls[i:i + run]):
                f = first.setdefault(body, (d, t, i))
                if f[:2] != (d, t) or i - f[2] >= run:
                    gone.update(range(i, i + run))
        left = [x for i, x in enumerate(ls) if i not in gone]
        out[d, t] = "\n".join(left) if not gone or any(x.strip(" ") for x in left) else ""
    return [(d, out.get((d, t))) for d, t in rows]


def test_runs_equal_brute_force(docs_of, sample, with_clashes):
    shared = ["\n".join(" ".join(words(6, 10 * s + k)) for k in range(9)) for s in range(4)]
    rows = [(k, "\n".join([" ".join(words(5, 900 + k)), shared[k % 4], " ".join(words(5, 700 + k))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "one line"), (104, shared[0] + "\n" + shared[0]), (5, rows[5][1]),
             (104, "other text"), (105, "z z\nz z\nz z"), (106, "y y\ny y\ny y\ny y\ny y"), (107, "a\n\n\n\n\nb")]
    rows += [(1000 + r.doc_id, r.text) for r in sample.collect()]
    df = with_clashes(docs_of(rows))
    got = lines.dedup_runs(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(without_runs(rows), key=str)
    assert lines.dedup_runs(docs_of([])).count() == 0


def test_later_exact_copies_are_emptied(docs_of):
    texts = ["\n".join(" ".join(words(4, 1000 * n + 100 * s + k)) for k in range(n)) for n in range(2, 14) for s in range(4)]
    texts += ["heading\n", "a b\n\n\n\n\nc d"]
    n = len(texts)
    rows = [(k, t) for k, t in enumerate(texts + texts)] + [(2 * n, "one line"), (2 * n + 1, "one line")]
    got = {r.doc_id: r for r in lines.dedup_runs(docs_of(rows), counts=True).collect()}
    assert [got[k].text for k in range(n)] == texts
    assert {got[n + k].text for k in range(n)} == {""}
    assert all(got[n + k].n_removed_lines == len(t.split("\n")) for k, t in enumerate(texts))
    assert got[2 * n + 1].text == "one line" and got[2 * n + 1].n_removed_chunks == 0


def test_short_passages_between_other_lines_go(docs_of):
    rows, left = [], {}
    for n in range(2, 6):
        for s in range(6):
            passage = [" ".join(words(20, 1000 * n + 10 * s + k)) for k in range(n)]
            for copy in range(3):
                own = [" ".join(words(5, 100_000 + 9 * len(rows) + k)) for k in range(4)]
                rows.append((len(rows), "\n".join(own[:2] + passage + own[2:])))
                left[rows[-1][0]] = rows[-1][1] if copy == 0 else "\n".join(own)
    got = lines.dedup_runs(docs_of(rows), counts=True).collect()
    assert {r.doc_id: r.text for r in got} == left
    assert sum(r.n_removed_chunks for r in got) == 48


# --- near duplicates ------------------------------------------------------


def test_percent_below_the_sketches_is_an_error(docs_of):
    with pytest.raises(ValueError):
        minhash.grouped(docs_of([(1, "a b c")]), 3, 74)


def sets_of(rows, k):
    out = []
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for d, t in rows:
        w = (t or "").encode().translate(low).split()
        out.append((d, frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows, k, percent):
    s = sets_of(rows, k)
    top = list(range(len(s)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (_, a) in enumerate(s):
        for j in range(i):
            b = s[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(s):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(a), min(least[root(i)], default=None)) for i, (d, a) in enumerate(s)), key=str)


def edited(ws, n, seed):
    ws, r = list(ws), random.Random(seed)
    for _ in range(n):
        ws[r.randrange(len(ws))] = f"new{r.randrange(10 ** 6)}"
    return ws


def near_rows():
    rows = []
    for g in range(12):
        first = words(40 + 30 * g, g)
        for k in range(8):
            rows.append((len(rows) * 3 % 1009, " ".join(edited(first, k // 2, 100 * g + k))))
    # A chain: each is near its neighbour, its ends are not.
    link = words(300, 77)
    for k in range(10):
        link = edited(link, 5, 5000 + k)
        rows.append((2000 + k, " ".join(link)))
    rows += [(3000, "tiny text"), (3001, "Tiny TEXT"), (3002, ""), (3003, None), (3004, " \n "), (3005, "a b c"), (3006, "a b c d"), (3000, "tiny text")]
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs_of, sample, with_clashes, k, percent):
    rows = near_rows() + [(5000 + r.doc_id, r.text) for r in sample.collect()]
    got = minhash.grouped(with_clashes(docs_of(rows)), k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, k, percent)


def test_blocks_and_stars_with_small_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SET_BLOCK", 3)
    first = words(120, 5)
    rows = [(k, " ".join(edited(first, 3, k))) for k in range(60)]
    got = minhash.grouped(docs_of(rows), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85)


def test_near_dedup_keeps_one_of_each_group(docs_of, with_clashes):
    rows = near_rows()
    df = with_clashes(docs_of(rows))
    got = minhash.near_dedup(df)
    assert got.columns == df.columns
    want = {c for d, n, c in brute_components(rows, 5, 80) if n}
    kept = [r.doc_id for r in got.collect() if (r.text or "").split()]
    assert sorted(kept) == sorted(want)
    assert minhash.near_dedup(docs_of([])).count() == 0
    nulls = minhash.near_dedup(docs_of([(None, "a b c d e f g")] * 2 + [(None, "z y x w v u t")])).collect()
    assert sorted(r.text for r in nulls) == ["a b c d e f g", "z y x w v u t"]


def test_estimate_is_near_the_truth():
    a, b = words(2000, 1), words(2000, 1)[:1800] + words(200, 9)
    known = minhash._WordHashes()
    x, y = (minhash.shingle_hashes(" ".join(w), 3, known) for w in (a, b))
    true = len(set(x) & set(y)) / len(set(x) | set(y))
    for width in (0, 4, 8):
        assert abs(float(minhash.estimate(minhash.registers(x, width), minhash.registers(y, width))) - true) < 0.1


def test_near_duplicates_share_a_width():
    for n in range(1, 5000):
        for m in {n, int(n / 0.8), int(n / 0.85)}:
            assert set(minhash.widths(n)) & set(minhash.widths(m))


# --- substrings -----------------------------------------------------------


def brute_spans(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] += 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        starts = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return out


def substring_rows():
    r = random.Random(3)
    rows = [(k, " ".join(words(r.randrange(1, 120), k))) for k in range(30)]
    passage = " ".join(words(60, 999))
    rows += [(100 + k, " ".join(words(20, 300 + k)) + passage[k:] + " ".join(words(10, 400 + k))) for k in range(12)]
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "abc" * 90 + "x" + "abc" * 90), (203, "a" * 199), (204, ""), (205, None), (206, "é" * 250)]
    rows += [(300, rows[0][1] * 3), (5, rows[5][1]), (None, passage), (301, "q" * 200), (302, "".join(chr(33 + k % 90) for k in range(200)))]
    return rows


def test_substrings_equal_brute_force(docs_of, with_clashes):
    rows = substring_rows()
    got = substrings.dedup_substrings(with_clashes(docs_of(rows))).collect()
    want = sorted(((d, *w) for (d, _), w in zip(rows, brute_spans([t for _, t in rows], 200), strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
    assert substrings.dedup_substrings(docs_of([])).count() == 0


def test_substrings_other_lengths_and_rounds(docs_of):
    r = random.Random(8)
    rows = [(k, "".join(r.choice("ab") for _ in range(r.randrange(0, 160)))) for k in range(60)]
    for grams in ((4, 9), (5, 8, 14)):
        got = substrings.dedup_substrings(docs_of(rows), 17, grams).collect()
        want = sorted((d, *w) for (d, _), w in zip(rows, brute_spans([t for _, t in rows], 17), strict=True))
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
