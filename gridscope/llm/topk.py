"""Operator 7: exact top-k by inner product with M-trees.

Vectors become integers; one further coordinate lifts all of them to the same
length, so that the largest inner product is the smallest Euclidean distance and
the triangle inequality holds.

Rows go to the nearest of a bounded number of routing vectors (regions); a
region is dealt into parts of about ``PART`` rows, each part is one task's M-tree:
paged nodes with routing vector, covering radius and distance to the parent, and
leaf pages with their objects' distances to the page's routing vector.  A tree
is one row of a stored table.

Queries are searched in blocks: first in their own region, which bounds the
k-th score; then only in those other regions whose covering radius that bound
doesn't exclude.  Inside a tree the search is best-first; stored distances
discard entries and objects before any distance to them is computed.  Scores
are integer inner products, bounds are widened by a relative ``SLACK``, so results
are exact.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscope.llm.common import stored
from gridscope.session import ship_package

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Rows of one tree, objects of a leaf page, entries of an inner node, queries of a block.
PART, PAGE, FAN, BLOCK = 32_768, 512, 16, 2_048
#: Routing vectors at most (they are sent to every task).
REGIONS = 512
SLACK = 1e-9


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, v array<long>, norm) of the usable rows: no null vector, no
    null or non-finite component."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale).cast("double") * c.cast("double")))
    rows = vectors.select("vec_id", "embedding").filter(fine & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", v.alias("v"))
    return stored(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)), "vectors")


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), dim), np.int64)
    for k, v in enumerate(lists):
        out[k, :len(v)] = v
    return out


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(top - (f * f).sum(axis=1), 0.0))])


def _far(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(axis=1))


class Tree:
    """An M-tree over one part."""

    def __init__(self, uid, vec_id, v, top: float, page: int = PAGE, fan: int = FAN):
        self.uid, self.vec_id, self.top, self.page, self.fan = uid, vec_id, top, page, fan
        # Sums of integer products are exact in floats below these bounds.
        self.kind = np.float32 if top < 2 ** 24 else np.float64 if top < 2 ** 53 else np.int64
        points, self.v = _lifted(v, top), v.astype(self.kind)
        # Inner node: (children, routing, to_parent, radius); leaf page: (None, rows, to_routing, vectors).
        self.nodes: list[tuple] = []
        order = np.arange(len(v))
        self.route = points[0]
        self.root = self._build(points, order, self.route)
        del self.v

    def _build(self, points, rows, route) -> int:
        d = _far(points[rows], route)
        # Objects at one place (equal vectors) can't be split by distance.
        if len(rows) <= self.page or d.max() <= SLACK * (1 + self.top):
            by = np.argsort(d, kind="stable")
            self.nodes.append((None, rows[by], d[by], np.ascontiguousarray(self.v[rows[by]])))
            return len(self.nodes) - 1
        routes = [points[rows[int(d.argmax())]]]
        nearest = _far(points[rows], routes[0])
        while len(routes) < min(self.fan, -(-len(rows) // self.page) + 1) and nearest.max() > 0:
            routes.append(points[rows[int(nearest.argmax())]])
            nearest = np.minimum(nearest, _far(points[rows], routes[-1]))
        to = np.stack([_far(points[rows], r) for r in routes])
        own = to.argmin(axis=0)
        children, route_rows, radii = [], [], []
        for k, r in enumerate(routes):
            mine = rows[own == k]
            if len(mine):
                children.append(self._build(points, mine, r))
                route_rows.append(r)
                radii.append(to[k, own == k].max())
        routes = np.stack(route_rows)
        self.nodes.append((children, routes, _far(routes, route), np.asarray(radii)))
        return len(self.nodes) - 1

    def search(self, uid: int, v: np.ndarray, k: int, least: int | None) -> list[tuple[int, int, int]]:
        """The k best (score, vec_id, uid) of at least ``least``, the query's own row left out."""
        q, own = np.append(v.astype(np.float64), 0.0), v.astype(self.kind)
        base = float(q @ q) + self.top
        scores, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def reach(score) -> float:
            """The distance at which a score of ``score`` lies, widened a little."""
            score = float(score)
            return math.sqrt(max(base - 2.0 * score, 0.0) + SLACK * (base + abs(score))) + SLACK

        limit = math.inf if least is None else reach(least)
        worst = -(2 ** 63) if least is None else least
        heap = [(0.0, 0, self.root, float(np.sqrt(((self.route - q) ** 2).sum())))]
        count = 0
        while heap:
            low, _, node, to_route = heapq.heappop(heap)
            if low > limit:
                break
            children, a, b, *more = self.nodes[node]
            if children is None:
                i, j = b.searchsorted((to_route - limit, to_route + limit)) if limit < math.inf else (0, len(b))
                got = np.asarray(more[0][i:j + 1] @ own).astype(np.int64)
                near = np.flatnonzero(got >= worst)
                some = a[i:j + 1][near]
                mine = self.uid[some] != uid
                scores, rows = np.concatenate([scores, got[near][mine]]), np.concatenate([rows, some[mine]])
                if len(rows) > k:
                    best = np.lexsort((self.uid[rows], self.vec_id[rows], -scores))[:k]
                    scores, rows = scores[best], rows[best]
                if len(rows) == k and (low_score := int(scores.min())) > worst:
                    worst = low_score
                    limit = min(limit, reach(worst))
                continue
            radius = more[0]
            near = np.flatnonzero(np.abs(to_route - b) - radius <= limit)  # before any distance
            d = _far(a[near], q)
            for c, far, r in zip(near, d, radius[near], strict=True):
                if far - r <= limit:
                    count += 1
                    heapq.heappush(heap, (max(low, far - r), count, children[c], float(far)))
        order = np.lexsort((self.uid[rows], self.vec_id[rows], -scores))
        got = [(int(scores[o]), int(self.vec_id[rows[o]]), int(self.uid[rows[o]])) for o in order]
        return got if least is None else [g for g in got if g[0] >= least]


def _placed(rows: DataFrame, routes: np.ndarray, dim: int, top: float) -> DataFrame:
    """rows with their region and the distance to its routing vector."""
    def run(batches):
        lifted = _lifted(routes, top)
        for b in batches:
            points = _lifted(_matrix(b.column(2), dim), top)
            d = np.stack([_far(points, r) for r in lifted])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(d.argmin(axis=0).astype(np.int32)),
                                              pa.array(d.min(axis=0))], names=["uid", "vec_id", "v", "region", "d"])

    return rows.select("uid", "vec_id", "v").mapInArrow(run, "uid long, vec_id long, v array<long>, region int, d double")


def _trees(placed: DataFrame, parts: dict[int, int], dim: int, top: float) -> DataFrame:
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        tree = Tree(table["uid"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["v"], dim), top)
        return pa.table({"region": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    sizes = F.create_map(*[F.lit(x) for r, n in parts.items() for x in (r, n)])[F.col("region")]
    dealt = placed.select("uid", "vec_id", "v", "region", F.pmod(F.xxhash64("uid"), sizes).alias("part"))
    return stored(dealt.groupBy("region", "part").applyInArrow(build, "region int, part long, tree binary"), "trees")


def _asked(trees: DataFrame, asks: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, query_id, uid, vec_id, score) from (region, query, query_id, v, least):
    a row of the join is one tree with one block of queries."""
    block = asks.groupBy("region", "block").agg(F.collect_list(F.struct("query", "query_id", "v", "least")).alias("qs"))
    both = trees.join(block, "region").select("tree", "qs")

    def run(batches):
        for b in batches:
            for tree, qs in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                tree = pickle.loads(tree.as_py())
                out: list[list] = [[] for _ in range(5)]
                for q in qs:
                    v = np.zeros(dim, np.int64)
                    v[:len(q["v"])] = q["v"]
                    for score, vec_id, uid in tree.search(q["query"], v, k, q["least"]):
                        for c, x in zip(out, (q["query"], q["query_id"], uid, vec_id, score), strict=True):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "query_id", "uid", "vec_id", "score"])

    return both.mapInArrow(run, "query long, query_id long, uid long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): per query row the k rows of largest inner
    product of the scaled integer vectors, ties to the smaller vec_id.

    Rows with a null id, a null vector or a null or non-finite component take no
    part; vectors of different lengths are compared as if filled with zeros.  A
    repeated row is a candidate of its own (it is not the query's own row).  An
    empty table, or one without queries, gives an empty result; other columns are
    not read."""
    rows = integers(vectors, scale)
    n, top, dim, asked = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v")), F.count_if(is_query)).first()
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    if not n or not asked:
        return empty
    top, dim = float(top) * (1 + 1e-12), max(int(dim), 1)
    few = rows.select("v").orderBy(F.xxhash64("uid")).limit(min(REGIONS, -(-n // PART))).collect()
    routes = np.zeros((len(few), dim), np.int64)
    for i, r in enumerate(few):
        routes[i, :len(r["v"])] = r["v"]
    placed = stored(_placed(rows, routes, dim, top), "placed")
    about = {r["region"]: (r["n"], r["radius"]) for r in placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()}
    trees = _trees(placed, {r: -(-c // PART) for r, (c, _) in about.items()}, dim, top)
    blocks = F.pmod(F.xxhash64("uid"), F.lit(-(-asked // BLOCK))).alias("block")
    queries = placed.filter(is_query).select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), "v", "region", blocks)
    first = stored(_asked(trees, queries.withColumn("least", F.lit(None).cast("long")), dim, k), "found")
    found = first
    if len(about) > 1:
        # The k-th score so far excludes regions that lie too far away.
        kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("s"))
        asks = queries.join(kth, "query", "left").withColumn("least", F.when(F.col("c") >= k, F.col("s")))
        lifted, radii = _lifted(routes, top), np.asarray([about.get(r, (0, -1.0))[1] for r in range(len(routes))])

        def others(batches):
            for b in batches:
                v = _matrix(b.column("v"), dim)
                points = np.column_stack([v.astype(np.float64), np.zeros(len(v))])
                base = (points * points).sum(axis=1) + top
                least = b.column("least").to_pylist()
                at, regions = [], []
                d = np.stack([_far(points, r) for r in lifted], axis=1)
                for i, (own, s) in enumerate(zip(b.column("region").to_pylist(), least, strict=True)):
                    limit = np.inf if s is None else np.sqrt(max(base[i] - 2.0 * s, 0.0) + SLACK * (base[i] + abs(s))) + SLACK
                    for r in np.flatnonzero((d[i] - radii <= limit) & (radii >= 0)):
                        if r != own:
                            at.append(i)
                            regions.append(r)
                yield b.select(["query", "query_id", "v", "block", "least"]).take(pa.array(at, pa.int64())).add_column(
                    5, "region", pa.array(regions, pa.int32()))

        asks = asks.select("query", "query_id", "v", "region", "block", "least").mapInArrow(
            others, "query long, query_id long, v array<long>, block long, least long, region int")
        found = first.union(_asked(trees, asks, dim, k))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every 20th vector."""
    ship_package(spark)
    return top_k(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
