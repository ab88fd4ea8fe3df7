"""Operator 10: near duplicates by HyperMinHash.

A document's set holds 64-bit hashes of its distinct word shingles.  A sketch has
``REGISTERS`` one-byte registers, each with the leading-zero count and ``MANTISSA``
further bits of the smallest value in a bucket.  Large sets fill all buckets of
one hash function; smaller ones use several functions with fewer buckets, so that
registers never stay empty or nearly so.  Documents with equal sets are one class
from then on.

Candidates are classes that share a band of ``BAND`` registers.  A band's bucket
is never expanded to all pairs:

1. every member is paired with the bucket's most popular member (one pair a row,
   whatever the bucket's size);
2. pairs that the collision-corrected estimate does not rule out are confirmed
   on the full sets, and the links give components;
3. buckets that still hold several components compare their members in blocks,
   first registers alone to find the members with a possible partner in another
   component, then those members' full sets; only confirmed links leave a task.

So no pair that shares a band is lost unless its two documents are already
connected.  Two documents at the threshold share none of the 42 bands with a
probability of (1 - s^6)^42: 2e-9 at s = 0.85, 3e-6 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import documents, lean, stored

REGISTERS = 256
MANTISSA = 4
BAND = 6
#: Standard errors below the threshold from which an estimate rules a pair out.
ERRORS = 5
#: Members of a bucket whose registers, and whose full sets, are compared at once.
BLOCK, SET_BLOCK = 512, 128
#: Words whose hashes a task remembers.
WORDS_HELD = 100_000
#: The lowest similarity that sketches are made for.
LOWEST = 0.75
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    """Word to 64-bit hash, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


_SEEDS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _M1)


def shingle_hashes(text: str | None, words: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (A-Z lowered)."""
    got = (text or "").encode("utf-8").translate(_LOWER).split()
    n = len(got)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, got), np.uint64, n)
    width = min(words, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _M1 + h[k:n - width + 1 + k])
    return np.unique(out)


def widths(n: int) -> list[int]:
    """log2 of the buckets per hash function for a set of ``n``: about eight values
    a bucket, so that hardly one stays empty.  A set near a step also takes the next
    width, because that is the one of its largest possible near duplicate."""
    own, above = (min(int(np.log2(REGISTERS)), max(0, int(np.log2(max(m / 8, 1))))) for m in (n, n / LOWEST))
    return [own] if own == above else [own, above]


def registers(hashes: np.ndarray, width: int) -> np.ndarray:
    """``REGISTERS`` bytes: per hash function (``REGISTERS`` >> ``width`` of them) and
    bucket the leading zeros (to 14) and mantissa of the smallest value; 255 for an
    empty bucket."""
    size, count = 1 << width, REGISTERS >> width
    h = _mix(hashes[None, :] ^ _SEEDS[:count, None])
    low = h << np.uint64(width)
    if width:
        least = np.full(REGISTERS, ~np.uint64(0), np.uint64)
        bucket = (h >> np.uint64(64 - width)).astype(np.int64) + np.arange(count)[:, None] * size
        np.minimum.at(least, bucket.ravel(), low.ravel())
    else:
        least = low.min(axis=1)
    zeros = np.minimum(63 - np.floor(np.log2(least.astype(np.float64) + 1.0)).astype(np.int64), 14).clip(0)
    after = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return np.where(least == ~np.uint64(0), 255, zeros << MANTISSA | after.astype(np.int64)).astype(np.uint8)


#: Chance that registers of different values agree: leading zeros z with chance
#: 2^-(z+1) each, and equal mantissas.
COLLISION = sum(4.0 ** -(z + 1) for z in range(15)) / 2 ** MANTISSA


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    some = (a != 255) | (b != 255)
    same = ((a == b) & some).sum(axis=-1) / np.maximum(some.sum(axis=-1), 1)
    return (same - COLLISION) / (1 - COLLISION)


def possible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimate lies at most ``ERRORS`` standard errors below the threshold."""
    some = np.maximum(((a != 255) | (b != 255)).sum(axis=-1), 1)
    return estimate(a, b) >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / some)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, x, cls, n, sketches): cls identifies the set (16 bytes, null if
    empty), sketches are (width, registers)."""
    kind = pa.list_(pa.struct([("width", pa.int32()), ("regs", pa.binary())]))

    def run(batches):
        known = _WordHashes()
        for b in batches:
            cls, sizes, regs = [], [], []
            for text in b.column(2):
                s = shingle_hashes(text.as_py(), words, known)
                sizes.append(len(s))
                cls.append(np.array([s.sum(), np.bitwise_xor.reduce(_mix(s + _M1))], "<u8").tobytes() if len(s) else None)
                regs.append([{"width": w, "regs": registers(s, w).tobytes()} for w in widths(len(s))] if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.binary()),
                                              pa.array(sizes, pa.int64()), pa.array(regs, kind)],
                                             names=["doc_id", "x", "cls", "n", "sketches"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, x long, cls binary, n long, sketches array<struct<width:int,regs:binary>>"
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x"), "text").mapInArrow(lean(run), schema)


def _bands(sketches: DataFrame) -> DataFrame:
    """(band, place, node, width): 64-bit keys of every band with a filled register
    and the band's number."""
    count = REGISTERS // BAND

    def run(batches):
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, REGISTERS)[:, :count * BAND]
            rows = regs.reshape(-1, count, BAND).astype(np.uint64)
            key = b.column(1).to_numpy().astype(np.uint64)[:, None] * np.uint64(count) + np.arange(count, dtype=np.uint64) + np.uint64(1)
            for k in range(BAND):
                key = _mix(key * _M1 + rows[:, :, k])
            row, band = np.nonzero((rows != 255).any(axis=2))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key[row, band].view(np.int64)), pa.array(band.astype(np.int32)),
                                              b.column(0).take(at), b.column(1).take(at)], names=["band", "place", "node", "width"])

    return sketches.select("node", "width", "regs").mapInArrow(lean(run), "band long, place int, node long, width int")


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of (a, b, width) whose estimate does not rule out the threshold."""
    both = (pairs.join(sketches.select(F.col("node").alias("a"), "width", F.col("regs").alias("ra")), ["a", "width"])
            .join(sketches.select(F.col("node").alias("b"), "width", F.col("regs").alias("rb")), ["b", "width"]).select("a", "b", "ra", "rb"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array(possible(ra, rb, threshold)))

    return both.mapInArrow(lean(run), "a long, b long")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets have 100 * intersection >= percent * union."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb"))

    def run(batches):
        for b in batches:
            keep = [linked(x.as_py(), y.as_py(), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the links, by rounds of
    taking the smallest label around and jumping to that label's label."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("comp").alias("top"))
        step = step.join(up, "to", "left").select("node", F.least("to", "top").alias("comp"), (F.least("to", "top") < F.col("comp")).alias("moved"))
        step = stored(step, "labels")
        labels = step.drop("moved")
        if not step.filter("moved").head(1):
            return labels


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """Every member with its bucket's most popular one: the member whose buckets
    hold most members in all.  Edited copies leave buckets, their original stays."""
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    popular = buckets.join(sizes, "band").groupBy("node").agg(F.sum("k").alias("pop"))
    centres = buckets.join(popular, "node").groupBy("band").agg(F.max_by("node", F.struct("pop", F.negative("node"))).alias("c"))
    got = buckets.join(centres, "band").filter("node != c")
    return got.groupBy(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).agg(F.min("width").alias("width"))


def _first_band(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The number of the first filled band in which ``a`` agrees with each row."""
    count = REGISTERS // BAND
    same = (rows[:, :count * BAND] == a[:count * BAND]).reshape(-1, count, BAND).all(axis=2)
    return (same & (a[:count * BAND].reshape(count, BAND) != 255).any(axis=1)).argmax(axis=1)


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(l, r): blocks of the members outside a bucket's main component, each with
    every block of the bucket's members.  ``members`` has band, node, comp, main and
    what is compared."""
    size = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    m = members.join(size, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = F.collect_list(F.struct(*[c for c in members.columns if c != "main"]))
    left = m.filter("comp != main").groupBy("band", "block").agg(rows.alias("l"))
    right = m.groupBy("band", F.col("block").alias("other")).agg(rows.alias("r"))
    return left.join(right, "band").select("l", "r")


def _candidates(one: pa.StructArray, two: pa.StructArray, threshold: float):
    """For each row of ``one`` the rows of ``two`` in other components that the
    estimate leaves possible; a pair counts in its first common band only."""
    (na, ca, ra), (nb, cb, rb) = (
        (x.field("node").to_numpy(), x.field("comp").to_numpy(),
         np.frombuffer(b"".join(x.field("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)) for x in (one, two))
    place = one.field("place")[0].as_py()
    for k in range(len(na)):
        at = np.flatnonzero(cb != ca[k])
        at = at[possible(ra[k], rb[at], threshold)]
        at = at[_first_band(ra[k], rb[at]) == place]
        if len(at):
            yield k, at


def _open_members(mixed: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The (band, node) that have a possible partner in another component."""
    both = _blocks(mixed.join(sketches, ["node", "width"]).select("band", "place", "node", "comp", "main", "regs"), BLOCK)

    def run(batches):
        for b in batches:
            for one, two in zip(b.column(0), b.column(1), strict=True):
                one, two = one.values, two.values
                hits = [(k, at) for k, at in _candidates(one, two, threshold)]
                nodes = np.unique(np.concatenate([np.zeros(0, np.int64), *(one.field("node").to_numpy()[[k]] for k, _ in hits),
                                                  *(two.field("node").to_numpy()[at] for _, at in hits)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), one.field("band")[0].as_py(), np.int64)), pa.array(nodes)],
                                                 names=["band", "node"])

    return both.mapInArrow(lean(run), "band long, node long").distinct()


def _block_links(members: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(a, b): the links between components inside buckets, confirmed on full sets
    where the blocks are compared."""
    m = members.join(sketches, ["node", "width"]).join(sets, "node")
    both = _blocks(m.select("band", "place", "node", "comp", "main", "regs", "hashes"), SET_BLOCK)

    def run(batches):
        for b in batches:
            for one, two in zip(b.column(0), b.column(1), strict=True):
                one, two = one.values, two.values
                na, nb, ha, hb = one.field("node"), two.field("node"), one.field("hashes"), two.field("hashes")
                out = [(na[k].as_py(), nb[int(j)].as_py()) for k, at in _candidates(one, two, threshold) for j in at
                       if linked(ha[k].as_py(), hb[int(j)].as_py(), percent)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                                 names=["a", "b"])

    return both.mapInArrow(lean(run), "a long, b long")


def _sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(node, hashes): full sets of the wanted (node, doc_id, x), texts compressed
    for their way through the shuffle."""
    def pressed(batches):
        press = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(
                [press.compress((t.as_py() or "").encode("utf-8")) for t in b.column(2)], pa.binary())], names=["d", "h", "z"])

    def full(batches):
        known = _WordHashes()
        for b in batches:
            texts = (zstandard.decompress(z.as_py()).decode("utf-8") for z in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                [shingle_hashes(t, words, known).astype("<u8").tobytes() for t in texts], pa.binary())], names=["node", "hashes"])

    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").mapInArrow(
        lean(pressed), f"d {dict(docs.dtypes)['doc_id']}, h long, z binary")
    wanted = need.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("x") == F.col("h"))).select("node", "z")
    return stored(wanted.mapInArrow(lean(full), "node long, hashes binary"), "sets")


def grouped(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, x, n_shingles, comp, component_id) per row of ``docs``, x the hash
    of its text, comp the group (null without words); component_id is the smallest doc_id reachable over links of at least
    ``percent`` similarity on ``words``-word shingles.

    A text with fewer words is one shingle; without words (null, empty, blank)
    the set is empty and linked with nothing: component_id is the row's own id.
    Repeated rows share a component.  Null ids are ignored by the minimum.  An
    empty table gives an empty one; other columns are not read.  A ``percent`` below
    100 * ``LOWEST`` is an error: pairs of unequal size would share no width."""
    if percent < 100 * LOWEST:
        raise ValueError(f"percent is {percent}; sketches are made for {100 * LOWEST:.0f} and more")
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    sketch = stored(_sketches(docs, words), "sketches")
    classes = sketch.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "x")).alias("at"), F.first("sketches").alias("sketches"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sketches = classes.select("node", F.inline("sketches"))
    bands = _bands(sketches)
    often = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("band")
    buckets = stored(bands.join(often, "band"), "buckets")
    # Full sets of the classes that share a bucket with another one.
    need = classes.join(buckets.select("node").distinct(), "node").select("node", "at.doc_id", "at.x")
    if sketch.groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").head(1):
        docs = docs.dropDuplicates(["doc_id", "text"])
    sets = _sets(docs, need, words)
    stars = stored(_likely(_star_pairs(buckets), sketches, threshold), "pairs")
    links = stored(_confirmed(stars, sets, percent), "links")
    comp = components(links)
    # Buckets that still hold more than one component.
    own = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = own.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", "k").alias("main")).filter("comps > 1")
    mixed = stored(own.join(mixed.select("band", "main"), "band"), "open-buckets")
    members = stored(mixed.join(_open_members(mixed, sketches, threshold), ["band", "node"]), "open-members")
    more = stored(_block_links(members, sketches, sets, threshold, percent), "links")
    if more.head(1):
        comp = components(links.union(more))
    label = classes.select("cls", "node", "doc_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = label.select("cls", "comp").join(lowest, "comp").select("cls", "comp", "component_id")
    out = sketch.drop("sketches").join(by_class, "cls", "left")
    return out.select("doc_id", "x", F.col("n").alias("n_shingles"), "comp",
                      F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id
    (null ids last, then the hash of the text); if that row is repeated, one of
    its copies.  Documents without words all stay.  Other columns are carried
    along, whatever their names."""
    found = stored(grouped(docs, words, percent), "groups")
    best = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "x")).alias("b"))
    kept = best.select(F.col("b.doc_id").alias("k_id"), F.col("b.x").alias("k_x"))
    copies = found.filter("comp IS NOT NULL").join(
        kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("x") == F.col("k_x")), "left_semi").groupBy("doc_id", "x").agg(
        F.count(F.lit(1)).alias("k"))
    blank = found.filter("comp IS NULL").select("doc_id", "x").distinct().withColumn("k", F.lit(1).cast("long"))
    kept = stored(copies.union(blank).select(F.col("doc_id").alias("k_id"), F.col("x").alias("k_x"), "k"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn(
        "_x", F.xxhash64(F.coalesce("_row.text", F.lit(""))))
    rows = rows.join(kept, F.col("_row.doc_id").eqNullSafe(kept["k_id"]) & (F.col("_x") == kept["k_x"]))
    if kept.filter("k > 1").head(1):
        once = rows.filter("k > 1").groupBy("k_id", "k_x").agg(F.first("_row").alias("_row"))
        rows = rows.filter("k = 1").select("_row").union(once.select("_row"))
    return rows.select("_row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document: 3-word shingles, similarity 0.85."""
    out = grouped(documents(spark, sf_dir, "doc_id", "text"), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


# All links by prefix filtering (two sets this similar share one of their rarest
# shingles), then the closure; for tables of a few thousand documents.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda k: array_to_string(list_slice(ws, k, k + 2), ' ')) END) AS s FROM w),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
f AS (SELECT s, count(*) AS f FROM g GROUP BY s),
o AS (SELECT g.r, g.s, n.n, row_number() OVER (PARTITION BY g.r ORDER BY f.f, g.s) AS pos FROM g JOIN f USING (s) JOIN n USING (r)),
p AS (SELECT r, s, n FROM o WHERE pos <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.r AS a, b.r AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.r < b.r
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
i AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS k FROM c JOIN g x ON x.r = a JOIN g y ON y.r = b AND y.s = x.s GROUP BY a, b),
l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT t.a AS r, min(w.doc_id) AS low FROM t JOIN w ON w.r = t.b GROUP BY t.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
