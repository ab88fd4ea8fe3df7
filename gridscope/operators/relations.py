"""Relationships between columns.

Correlation matrices come from one aggregate holding every pair's
``corr`` (pairwise-complete, like pandas); rank correlations from the
bucketed average-rank primitive; Kendall's tau-b from an exact O(n log n)
concordance count over bit levels of the y-rank; functional dependencies
from approximate-distinct pruning plus exact verification.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions import special
from gridscope.functions.columns import c, num, safe_corr
from gridscope.operators.order import average_ranks, cumulative


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def pearson_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(var1, var2, corr, n)`` for every pair i < j, pairwise-complete."""
    nd = df.select(*[num(df, x).alias(x) for x in cols])
    recs = []
    for a, b in _pairs(cols):
        recs.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                             safe_corr(c(a), c(b)).alias("corr"),
                             F.count(F.when(c(a).isNotNull() & c(b).isNotNull(), 1)).alias("n")))
    if not recs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, corr double, n long")
    return nd.agg(F.array(*recs).alias("r")).select(F.inline("r"))


def matrix_form(pairs: DataFrame, cols: list[str], value: str = "corr") -> DataFrame:
    """Square matrix from long pairs: ``(variable, col_1 ... col_k)`` with 1.0
    on the diagonal.  Input is k(k-1)/2 rows."""
    sym = pairs.select("var1", "var2", value).unionByName(
        pairs.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), value))
    diag = pairs.sparkSession.createDataFrame([(x, x, 1.0) for x in cols], f"var1 string, var2 string, {value} double")
    return sym.unionByName(diag).groupBy(F.col("var1").alias("variable")).pivot("var2", cols).agg(F.first(value))


def _ranked(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each column by its average rank (ties share the mean rank).
    Each rank table is over distinct values and joins back on the value."""
    out = df.select(*[num(df, x).alias(x) for x in cols]).withColumn("_rid", F.monotonically_increasing_id())
    for x in cols:
        r = average_ranks(out, x).select(c(x), F.col("avg_rank").alias(f"_r_{x}"))
        out = out.join(r, x, "left")
    return out.select("_rid", *[F.col(f"_r_{x}").alias(x) for x in cols])


def spearman_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson over average ranks, pairwise-complete.  Columns without
    NULLs are ranked once; a pair involving NULLs is ranked on its complete
    rows only (as pandas does)."""
    nd = df.select(*[num(df, x).alias(x) for x in cols])
    nulls = nd.agg(*[F.count_if(c(x).isNull()).alias(x) for x in cols]).first().asDict()
    clean = [x for x in cols if nulls[x] == 0]
    parts = []
    if len(clean) >= 2:
        parts.append(pearson_pairs(_ranked(nd, clean), clean))
    for a, b in _pairs(cols):
        if a in clean and b in clean:
            continue
        sub = nd.select(a, b).dropna()
        parts.append(pearson_pairs(_ranked(sub, [a, b]), [a, b]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _dense_codes(df: DataFrame, col: str, out: str, by: list[str]) -> DataFrame:
    """Distinct values (per ``by`` group) with their count ``_n`` and dense
    0-based code in value order."""
    vc = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    pos = cumulative(vc, [col], by=by, weight="_one", out="_c")
    return pos.select(*by, col, "_n", (F.col("_c") - 1).cast("long").alias(out))


def kendall_pairs(df: DataFrame, cols: list[str] | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """exact tau-b for every pair, all pairs in one set of jobs
    (O(n log n) rows per pair, pairwise-complete).

    Pairs of rows that differ in y-rank diverge at exactly one highest bit
    level L.  Within a group (L, ry >> (L + 1)), a row with bit L = 1 is
    above every row with bit 0, so its concordant partners are the bit-0 rows
    with a smaller x-rank and its discordant partners those with a larger
    x-rank: running sums over x inside each group (range-bucketed when a
    group is large, never one task for everything)."""
    spark = df.sparkSession
    pairs = pairs or _pairs(cols or [])
    schema = "var1 string, var2 string, tau_b double, n long"
    if not pairs:
        return spark.createDataFrame([], schema)
    arr = F.array(*[F.struct(F.lit(i).alias("pair"), num(df, a).alias("x"), num(df, b).alias("y"))
                    for i, (a, b) in enumerate(pairs)])
    p = df.select(F.inline(arr)).dropna()
    cx, cy = _dense_codes(p, "x", "rx", ["pair"]), _dense_codes(p, "y", "ry", ["pair"])
    # Pair counts grow with the square of the rows: decimal sums, no overflow.
    wide = lambda x: x.cast("decimal(19,0)")
    two = lambda x: F.sum(wide(x) * wide(x - 1)) / 2
    sx = cx.groupBy("pair").agg(F.sum("_n").alias("n"), two(F.col("_n")).alias("tx"))
    sy = cy.groupBy("pair").agg(two(F.col("_n")).alias("ty"), F.max("ry").alias("maxr"))
    stats = {r["pair"]: r for r in sx.join(sy, "pair").collect()}
    maxr = max([r["maxr"] for r in stats.values()] + [0])
    levels = max(1, int(maxr).bit_length())
    joint = (p.join(cx.select("pair", "x", "rx"), ["pair", "x"]).join(cy.select("pair", "y", "ry"), ["pair", "y"])
             .groupBy("pair", "rx", "ry").agg(F.count(F.lit(1)).alias("w")))
    ex = joint.select("pair", "rx", "w", "ry", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("L"))
    ex = ex.select(
        "pair", "L", F.expr("ry >> (L + 1)").alias("g"), "rx", F.expr("(ry >> L) & 1").alias("bit"), "w")
    grid = ex.groupBy("pair", "L", "g", "rx").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("w")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0)).alias("n1"))
    cum = cumulative(grid, ["rx"], by=["pair", "L", "g"], weight="n0", out="c0")
    tot = grid.groupBy("pair", "L", "g").agg(F.sum("n0").alias("t0"))
    sums = {r["pair"]: r for r in cum.join(tot, ["pair", "L", "g"]).groupBy("pair").agg(
        F.sum(wide(F.col("n1")) * wide(F.col("c0") - F.col("n0"))).alias("conc"),
        F.sum(wide(F.col("n1")) * wide(F.col("t0") - F.col("c0"))).alias("disc")).collect()}
    rows = []
    for i, (a, b) in enumerate(pairs):
        st = stats.get(i)
        n_row = int(st["n"]) if st else 0
        sm = sums.get(i)
        n0 = n_row * (n_row - 1) / 2
        den = math.sqrt(max(n0 - float(st["tx"]), 0) * max(n0 - float(st["ty"]), 0)) if st else 0.0
        s_val = float((sm["conc"] or 0) - (sm["disc"] or 0)) if sm else 0.0
        rows.append((a, b, s_val / den if den > 0 else None, n_row))
    return spark.createDataFrame(rows, schema)


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """F3 for one pair."""
    return kendall_pairs(df, pairs=[(x, y)])


def strong_pairs(pairs: DataFrame, value: str = "corr", threshold: float = 0.7,
                 strict: bool = False, very_strong: float = 0.9, strong_label_at: float | None = None,
                 ordered: bool = True) -> DataFrame:
    """pairs with |r| >= threshold (> when ``strict``), with strength and
    direction, sorted by |r| descending (``ordered=False`` keeps the pair
    order, as the structure analysis lists them).  The statistics module labels
    > 0.9 very_strong else strong; the semantic module (``strong_label_at``
    = 0.8) labels > 0.8 strong else moderate."""
    r = F.col(value)
    keep = F.abs(r) > threshold if strict else F.abs(r) >= threshold
    if strong_label_at is not None:
        strength = F.when(F.abs(r) > strong_label_at, "strong").otherwise("moderate")
    else:
        strength = F.when(F.abs(r) > very_strong, "very_strong").otherwise("strong")
    out = (pairs.filter(keep).withColumn("strength", strength)
           .withColumn("direction", F.when(r > 0, "positive").otherwise("negative")))
    return out.orderBy(F.desc(F.abs(r)), "var1", "var2") if ordered else out


def cross_products(df: DataFrame, cols: list[str], fill_zero: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and the centred cross-product matrix of ``cols`` from one
    aggregate (k(k+1)/2 sums; centring by the means first for stability)."""
    nd = df.select(*[(F.coalesce(num(df, x), F.lit(0.0)) if fill_zero else num(df, x)).alias(x)
                      for x in cols])
    m = nd.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c(x)).alias(x) for x in cols]).first()
    n = m["_n"]
    means = np.array([m[x] or 0.0 for x in cols])
    cen = nd.select(*[(c(x) - F.lit(float(means[i]))).alias(x) for i, x in enumerate(cols)])
    idx = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = cen.agg(*[F.sum(c(cols[i]) * c(cols[j])).alias(f"s{i}_{j}") for i, j in idx]).first()
    S = np.zeros((len(cols), len(cols)))
    for i, j in idx:
        S[i, j] = S[j, i] = row[f"s{i}_{j}"] or 0.0
    return means, S, n


def partial_correlations(df: DataFrame, cols: list[str], alpha: float = 0.05,
                         complete_cases: bool = False) -> DataFrame:
    """each pair's correlation given all other columns (NULL -> 0, as the
    reference imputes; ``complete_cases`` drops rows with a NULL instead),
    from the inverse of the cross-product matrix: r = -P_ij / sqrt(P_ii P_jj).
    p-value by Student t with n - 2 df."""
    spark = df.sparkSession
    schema = "var1 string, var2 string, correlation double, p_value double, significant boolean, error string"
    if len(cols) < 3:
        return spark.createDataFrame([], schema)
    data = df.dropna(subset=cols) if complete_cases else df
    _, S, n = cross_products(data, cols)
    try:
        P = np.linalg.inv(S)
    except np.linalg.LinAlgError as e:
        return spark.createDataFrame([(None, None, None, None, None, str(e))], schema)
    rows = []
    for i, j in [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]:
        r = float(-P[i, j] / math.sqrt(P[i, i] * P[j, j]))
        r = max(-1.0, min(1.0, r))
        t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)) if n > 2 else float("nan")
        p = special.t_two_sided(t, n - 2) if n > 2 else None
        rows.append((cols[i], cols[j], r, p, bool(p is not None and p < alpha), None))
    return spark.createDataFrame(rows, schema)


#: Rows in which counter-examples are looked for before whole tables are grouped.
REFUTING_ROWS = 20_000


def _refuted(txt: DataFrame, cols: list[str]) -> tuple[set[tuple[str, str]], set[str]]:
    """Among some rows (whichever they are): pairs a -> b with a counter-example and
    columns with a repeated value.  Those can't hold and can't be keys; nothing else
    is concluded from them."""
    some = txt.limit(REFUTING_ROWS).toPandas()
    pairs, repeated = set(), set()
    for a in cols:
        there = some[some[a].notna()]
        kinds = there.groupby(a).nunique()
        pairs |= {(a, b) for b in cols if b != a and (kinds[b] > 1).any()}
        repeated |= {a} if there[a].duplicated().any() else set()
    return pairs, repeated


def _keys(txt: DataFrame, cols: list[str]) -> set[str]:
    """The columns whose non-null values are all distinct: one shuffle of
    (column, value) pairs, combined before it."""
    if not cols:
        return set()
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("k"), c(x).alias("a")) for x in cols])).alias("t")
    per = txt.select(pairs).select("t.k", "t.a").filter("a IS NOT NULL").groupBy("k", "a").agg(F.count(F.lit(1)).alias("n"))
    repeated = per.groupBy("k").agg(F.max("n").alias("most")).filter("most > 1").collect()
    return set(cols) - {r["k"] for r in repeated}


def functional_dependencies(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """ordered pairs a -> b where every non-null a value has exactly one
    distinct non-null b (a group whose b is all NULL fails).

    Pairs refuted by a bounded number of rows are left out; all others are verified
    exactly over all rows.  Keys come first: their classes are single rows, so a key
    determines b when b is nowhere null beside it, which one aggregate without a
    shuffle of rows tells for all keys.  The other determinants have classes of
    several rows and share one aggregate with map-side combining, in which a row
    takes part once per determinant and carries that determinant's candidates.
    ``is_key`` flags a determinant whose values are all distinct (it determines
    every column).  An all-null determinant or an empty table has no counter-example,
    so the dependency holds with 0 groups."""
    cols = cols or df.columns
    spark = df.sparkSession
    txt = df.select(*[c(x).cast("string").alias(x) for x in cols])
    never, repeated = _refuted(txt, cols)
    cands = {a: [b for b in cols if b != a and (a, b) not in never] for a in cols}
    cands = {a: bs for a, bs in cands.items() if bs}
    keys = _keys(txt, [a for a in cands if a not in repeated])
    alone = [F.count_if(c(a).isNotNull() & c(b).isNull()).alias(f"bad_{cols.index(a)}_{cols.index(b)}") for a in keys for b in cands[a]]
    one = txt.agg(*[F.count(c(x)).alias(f"nn_{i}") for i, x in enumerate(cols)], *alone).first().asDict()
    found = {(a, b): (one[f"nn_{cols.index(a)}"], one[f"bad_{cols.index(a)}_{cols.index(b)}"]) for a in keys for b in cands[a]}
    rest = [a for a in cands if a not in keys]
    if rest:
        width = max(len(cands[a]) for a in rest)
        slots = lambda a: [c(b) for b in cands[a]] + [F.lit(None).cast("string")] * (width - len(cands[a]))
        rows = F.filter(F.array(*[F.when(c(a).isNotNull(), F.struct(
            F.lit(i).alias("k"), c(a).alias("a"), *[b.alias(f"b{j}") for j, b in enumerate(slots(a))])) for i, a in enumerate(rest)]),
            lambda r: r.isNotNull())
        each = txt.select(F.explode(rows).alias("t")).select("t.*")
        per_a = each.groupBy("k", "a").agg(*[f(f"b{j}").alias(f"{n}{j}") for j in range(width) for n, f in (("lo", F.min), ("hi", F.max))])
        bad = [F.count_if(F.col(f"lo{j}").isNull() | (F.col(f"lo{j}") != F.col(f"hi{j}"))).alias(f"bad{j}") for j in range(width)]
        res = {r["k"]: r for r in per_a.groupBy("k").agg(F.count(F.lit(1)).alias("groups"), *bad).collect()}
        for i, a in enumerate(rest):
            found |= {(a, b): (res[i]["groups"], res[i][f"bad{j}"]) if i in res else (0, 0) for j, b in enumerate(cands[a])}
    held = [(a, b, "functional_dependency", "complete", int(found[a, b][0]), found[a, b][0] == one[f"nn_{cols.index(a)}"])
            for a in cands for b in cands[a] if not found[a, b][1]]
    return spark.createDataFrame(held, "determinant string, dependent string, type string, strength string, groups long, is_key boolean")


def scatter_fit(df: DataFrame, x: str, y: str, min_abs_r: float = 0.3) -> DataFrame:
    """F8: correlation, slope, intercept (line shown only when |r| > 0.3) and
    the strength words used by the chart annotations."""
    xv, yv = num(df, x), num(df, y)
    ok = xv.isNotNull() & yv.isNotNull()
    agg = df.agg(safe_corr(F.when(ok, xv), F.when(ok, yv)).alias("correlation"),
                 F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
                 F.regr_count(yv, xv).alias("n"))
    r = F.abs(F.col("correlation"))
    # Strength words at |r| >= 0.8 / 0.6 / 0.4 / 0.2
    words = (F.when(r >= 0.8, "muito forte").when(r >= 0.6, "forte").when(r >= 0.4, "moderada")
             .when(r >= 0.2, "fraca").otherwise("muito fraca"))
    return agg.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "correlation", "slope", "intercept",
                      (r > min_abs_r).alias("show_line"), words.alias("strength"))


def strongest_pair(pairs: DataFrame, value: str = "corr") -> DataFrame:
    """the most positive and the most negative off-diagonal pair
    (cells equal to 1.0 are skipped, as the reference does)."""
    p = pairs.filter(F.col(value) != 1.0)
    return p.agg(
        F.max_by(F.struct("var1", "var2", value), F.col(value)).alias("pos"),
        F.min_by(F.struct("var1", "var2", value), F.col(value)).alias("neg")).select(
        F.col("pos.var1").alias("pos_var1"), F.col("pos.var2").alias("pos_var2"), F.col(f"pos.{value}").alias("pos_corr"),
        F.col("neg.var1").alias("neg_var1"), F.col("neg.var2").alias("neg_var2"), F.col(f"neg.{value}").alias("neg_corr"))


def similar_columns(df: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """groups of similar columns.  Transposing the table (columns as
    observations) does not scale; columns are clustered on their correlation
    profile instead: the k x k correlation matrix comes from one Spark
    aggregate and k-means runs on those k points on the driver.
    k = min(5, #cols // 2); only groups with more than one column."""
    spark = df.sparkSession
    schema = "cluster_id int, columns array<string>, size int"
    k = min(5, len(cols) // 2)
    if len(cols) < 3 or k < 2:
        return spark.createDataFrame([], schema)
    _, S, n = cross_products(df, cols)
    d = np.sqrt(np.clip(np.diag(S), 1e-300, None))
    R = S / np.outer(d, d)
    X = (R - R.mean(axis=0)) / np.where(R.std(axis=0) > 0, R.std(axis=0), 1.0)
    labels = _kmeans_small(X, k, seed)
    rows = []
    for cid in range(k):
        members = [cols[i] for i in range(len(cols)) if labels[i] == cid]
        if len(members) > 1:
            rows.append((cid, members, len(members)))
    return spark.createDataFrame(rows, schema)


def _kmeans_small(X: np.ndarray, k: int, seed: int, iters: int = 100) -> np.ndarray:
    """Lloyd's algorithm with k-means++ seeding on a handful of points."""
    rng = np.random.default_rng(seed)
    centers = [X[rng.integers(len(X))]]
    for _ in range(1, k):
        d2 = np.min([((X - cc) ** 2).sum(axis=1) for cc in centers], axis=0)
        probs = d2 / d2.sum() if d2.sum() > 0 else np.full(len(X), 1 / len(X))
        centers.append(X[rng.choice(len(X), p=probs)])
    C = np.array(centers)
    labels = np.zeros(len(X), dtype=int)
    for _ in range(iters):
        new = np.argmin(((X[:, None, :] - C[None, :, :]) ** 2).sum(axis=2), axis=1)
        if np.array_equal(new, labels) and _ > 0:
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                C[j] = X[labels == j].mean(axis=0)
    return labels
