"""Operator 13: a Merkle manifest of a dataset, its subtrees in van Emde Boas order.

A leaf is the sha256 of a document's columns, computed where the document is read;
texts are never shuffled.  The leaves of each language, in order of doc_id, get their
places from range buckets and are cut into aligned blocks of ``2**HEIGHT``.  A block is
one row of a stored table: a subtree whose digests lie in van Emde Boas order (the
tree is split at half its height, the top part first, then the parts below it, each
laid out alike), so a walk from a leaf to the root stays within few neighbouring
stretches of memory at every size of cache.  The blocks' roots are the leaves of the
next table of blocks, and so on up to one root a language; the languages' roots are
the leaves of one more such tree.

Proofs come from above: a block gets the siblings of its own root from the table
above it, and adds those inside it for each of its leaves.  A task holds one block
(at most ``2**HEIGHT`` leaves) at a time, whatever the size of a language.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscope.llm.common import documents, stored
from gridscope.operators.order import deal

#: Levels of a block below its root.
HEIGHT = 11
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
_SIZE = 32


@lru_cache(maxsize=64)
def addresses(levels: int) -> np.ndarray:
    """The place of every node of a complete tree of ``levels`` levels; nodes are numbered
    level by level from the root."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    low = levels - top
    upper, lower = addresses(top), addresses(low)
    out = np.empty(2 ** levels - 1, np.int64)
    out[:2 ** top - 1] = upper
    first = (2 ** top - 1) + (2 ** low - 1) * np.arange(2 ** top)  # where each lower tree starts
    for d in range(low):
        inner = lower[2 ** d - 1:2 ** (d + 1) - 1]
        out[2 ** (top + d) - 1:2 ** (top + d + 1) - 1] = (first[:, None] + inner[None, :]).ravel()
    return out


class Block:
    """The subtree over up to ``2**height`` leaves; ``digests`` holds them in van Emde Boas order."""

    def __init__(self, height: int, n: int, digests: bytearray | bytes):
        self.height, self.n, self.digests = height, n, digests
        self.place = (_SIZE * addresses(height + 1)).tolist()
        self.counts = [-(-n // 2 ** (height - d)) for d in range(height + 1)]  # nodes by depth

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        out = cls(height, len(leaves), bytearray(_SIZE * (2 ** (height + 1) - 1)))
        for i, x in enumerate(leaves):
            out.put(height, i, x)
        for d in range(height - 1, -1, -1):
            for i in range(out.counts[d]):
                two = out.get(d + 1, 2 * i)
                if 2 * i + 1 < out.counts[d + 1]:
                    two += out.get(d + 1, 2 * i + 1)
                out.put(d, i, hashlib.sha256(two.encode()).digest())
        return out

    def get(self, depth: int, i: int) -> str:
        at = self.place[2 ** depth - 1 + i]
        return self.digests[at:at + _SIZE].hex()

    def put(self, depth: int, i: int, digest: bytes) -> None:
        at = self.place[2 ** depth - 1 + i]
        self.digests[at:at + _SIZE] = digest

    def way(self, i: int) -> tuple[str, list[str]]:
        """From leaf ``i`` to the root: a digit a level, 0 where the sibling stands left,
        1 where it stands right, 2 where there is none; and the siblings in hex."""
        sides, siblings = "", []
        for d in range(self.height, 0, -1):
            if i % 2:
                sides += "0"
                siblings.append(self.get(d, i - 1))
            elif i + 1 < self.counts[d]:
                sides += "1"
                siblings.append(self.get(d, i + 1))
            else:
                sides += "2"
            i //= 2
        return sides, siblings


def fold(digest: str, sides: str, siblings: list[str]) -> str:
    """The root above ``digest`` (hex), by a ``way``."""
    at = iter(siblings)
    for s in sides:
        two = digest if s == "2" else next(at) + digest if s == "0" else digest + next(at)
        digest = hashlib.sha256(two.encode()).hexdigest()
    return digest


def _field(name: str, plus: int = 0) -> Column:
    x = (F.col(name) + F.lit(plus)) if plus else F.col(name)
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf_digest(plus: int = 0, fields=FIELDS, counted: str = "n_chars") -> Column:
    """sha256 (hex) of the row; ``plus`` is added to the column ``counted`` (nulls stay)."""
    return F.sha2(F.concat(*[_field(x, plus if x == counted else 0) for x in fields]), 256)


def placed(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place in the row's group from 0, and ``n``, its size."""
    dealt = deal(leaves, [group, *order])
    part = [group, "_gs_b"]
    counts = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(group).orderBy("_gs_b").rowsBetween(Window.unboundedPreceding, -1)
    about = counts.select(*part, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    rows = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return rows.join(about, part).withColumn("pos", F.col("off") + F.col("_r") - 1).drop("_gs_b", "_r", "off", "c")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Subtrees of ``2**height`` leaves (lower ones where a group has fewer) over
    (g, pos, n, id, digest, forged)."""
    schema = "g string, block long, n long, height int, ids array<string>, forged array<binary>, digests binary, root string"

    def build(key, table):
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        tree = Block.build(table.column("digest").to_pylist(), min(height, (n - 1).bit_length()))
        one = {"g": key[0].as_py(), "block": key[1].as_py(), "n": n, "height": tree.height, "ids": table.column("id").to_pylist(),
               "forged": table.column("forged").to_pylist(), "digests": bytes(tree.digests), "root": tree.get(0, 0)}
        return pa.table({k: pa.array([x], _ARROW[k]) for k, x in one.items()})

    rows = nodes.select("g", F.floor(F.col("pos") / F.lit(2 ** height)).cast("long").alias("block"), "pos", "n", "id", "digest", "forged")
    return stored(rows.groupBy("g", "block").applyInArrow(build, schema), "merkle-blocks")


_ARROW = {"g": pa.string(), "block": pa.int64(), "n": pa.int64(), "height": pa.int32(), "ids": pa.list_(pa.string()),
          "forged": pa.list_(pa.binary()), "digests": pa.binary(), "root": pa.string()}


def forest(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The block tables of the trees over ``nodes`` (g, pos, n, id, digest, forged), lowest
    first; a group's last block stands in the table in which it fits one."""
    out = [_blocks(nodes, height)]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > 2 ** height:
        most = -(-most // 2 ** height)
        more = out[-1].filter(F.col("n") > 2 ** height).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(2 ** height)).cast("long").alias("n"),
            F.lit(None).cast("string").alias("id"), F.unhex("root").alias("digest"), F.lit(None).cast("binary").alias("forged"))
        out.append(_blocks(more, height))
    return out


def roots(tables: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(g, root) of every tree."""
    return reduce(DataFrame.unionAll, [t.filter(F.col("n") <= 2 ** height).select("g", "root") for t in tables])


def _ways(height: int):
    """(place, id, leaf, way) of every leaf of a block, the way going on above the block's root."""
    def of(r: dict):
        tree = Block(r["height"], len(r["ids"]), r["digests"])
        for i, name in enumerate(r["ids"]):
            sides, siblings = tree.way(i)
            yield r["block"] * 2 ** height + i, name, tree.get(tree.height, i), r["forged"][i], sides + r["sides"], siblings + r["siblings"]
    return of


def _columns(spark_schema: str, rows: list[tuple], types: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in spark_schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def with_ways(tables: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest table's blocks with the way from their root to the top: ``above``
    (g, sides, siblings, and more columns to carry) goes on from the trees' roots."""
    more = [x for x in above.columns if x not in ("g", "sides", "siblings")]
    schema = "g string, block long, sides string, siblings array<string>"
    ways = _ways(height)

    def down(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = [(r["g"], pos, sides, siblings) for pos, _, _, _, sides, siblings in ways(r)]
                yield _columns(schema, rows, [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())])

    got = None
    for t in reversed(tables):
        whole = t.filter(F.col("n") <= 2 ** height).join(above.select("g", "sides", "siblings"), "g")
        if got is not None:
            whole = whole.unionByName(t.filter(F.col("n") > 2 ** height).join(got, ["g", "block"]))
        got = whole.mapInArrow(down, schema) if t is not tables[0] else whole
    return got.join(above.select("g", *more), "g") if more else got


def manifest(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    ``docs`` has doc_id, source, lang, n_chars and text.  A null column is ``-`` in a leaf;
    null languages are one group, before the others.  Leaves ascend by doc_id (null
    first), equal ids by leaf; repeated rows have a leaf each.  Rows where ``tampered``
    holds are folded from the leaf of the row with 1 added to n_chars (a null stays null
    and verifies).  A single document is its own root, and its proof hashes the empty
    text.  Texts of any length are hashed whole.  An empty table gives an empty
    result; other columns are not read."""
    rows = docs.select(*FIELDS, F.coalesce(tampered, F.lit(False)).alias("_tampered")).select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("g"), "doc_id",
        F.col("doc_id").cast("string").alias("id"), F.unhex(leaf_digest()).alias("digest"),
        F.when(F.col("_tampered"), F.unhex(leaf_digest(1))).alias("forged"))
    tables = forest(placed(rows, "g", ["doc_id", "digest", "forged"]), height)
    langs = stored(roots(tables, height), "merkle-roots").select(
        F.lit("").alias("g"), F.col("g").alias("id"), F.unhex("root").alias("digest"), F.lit(None).cast("binary").alias("forged"))
    upper = forest(placed(langs, "g", ["id"]), height)
    top = roots(upper, height).withColumnRenamed("root", "top")
    start = top.select("g", F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"), "top")
    ways = _ways(height)
    above_schema = "g string, subroot string, top string, sides string, siblings array<string>"
    texts = pa.list_(pa.string())

    def per_language(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = [(name, leaf, r["top"], sides, siblings) for _, name, leaf, _, sides, siblings in ways(r)]
                yield _columns(above_schema, rows, [pa.string()] * 4 + [texts])

    above = stored(with_ways(upper, start, height).mapInArrow(per_language, above_schema), "merkle-above")
    told_schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def told(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = [(name, leaf, r["subroot"], r["top"], hashlib.sha256("".join(siblings).encode()).hexdigest(),
                         fold(leaf if forged is None else forged.hex(), sides, siblings))
                        for _, name, leaf, forged, sides, siblings in ways(r)]
                yield _columns(told_schema, rows, [pa.string()] * 6)

    out = with_ways(tables, above, height).mapInArrow(told, told_schema)
    return out.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def every_seventh(doc_id: Column, every: int = TAMPER_EVERY) -> Column:
    """``every`` divides the unsigned crc32 of the decimal id (never a null one's)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % every == 0


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return manifest(documents(spark, sf_dir, *FIELDS), every_seventh(F.col("doc_id")))


def crc_sql(text: str) -> str:
    """DuckDB has no crc32: its table of 256 words, from the polynomial, and one step a byte."""
    words = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        words.append(i)
    step = f"xor(c >> 8, ([{', '.join(map(str, words))}])[(xor(c & 255, x) + 1)::INTEGER])"
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {step}), 4294967295::BIGINT)"


def _leaf_sql(n_chars: str) -> str:
    told = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")]
    return f"sha256({' || '.join(told)})"


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN ({crc_sql('doc_id::VARCHAR')}) % 7 = 0 THEN {_leaf_sql('n_chars + 1')} END AS forged FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, forged NULLS FIRST) - 1 AS pos FROM d),
t(g, lvl, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY pos) FROM p GROUP BY g
  UNION ALL
  SELECT g, lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM t WHERE len(nodes) = 1),
u(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM s
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM u WHERE len(nodes) > 1),
h AS (SELECT g, max(lvl) AS height FROM t GROUP BY g),
ways AS (
  SELECT p.g, p.pos, t.lvl, p.pos // (1 << t.lvl) AS i, t.nodes FROM p JOIN t ON p.g = t.g AND len(t.nodes) > 1
  UNION ALL
  SELECT p.g, p.pos, h.height + u.lvl, s.place // (1 << u.lvl), u.nodes FROM p JOIN s ON p.g = s.g JOIN h ON p.g = h.g JOIN u ON len(u.nodes) > 1),
w AS (SELECT g, pos, list({{'left': i % 2 = 1, 'x': nodes[(CASE WHEN i % 2 = 1 THEN i ELSE i + 2 END)::INTEGER]}} ORDER BY lvl) AS steps FROM ways GROUP BY g, pos),
f(g, pos, k, cur) AS (
  SELECT g, pos, 1, coalesce(forged, leaf) FROM p
  UNION ALL
  SELECT f.g, f.pos, k + 1, sha256(CASE WHEN steps[k].left THEN steps[k].x || cur ELSE cur || coalesce(steps[k].x, '') END)
  FROM f JOIN w ON f.g = w.g AND f.pos = w.pos WHERE k <= len(steps)),
e AS (SELECT g, pos, arg_max(cur, k) AS folded_root FROM f GROUP BY g, pos)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(array_to_string(list_filter(list_transform(w.steps, lambda z: z.x), lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
       e.folded_root, e.folded_root = r.root AS verified
FROM p JOIN s USING (g) JOIN e USING (g, pos) LEFT JOIN w USING (g, pos), (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) r
"""
