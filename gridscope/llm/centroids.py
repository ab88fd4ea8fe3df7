"""Operator 11: centroid clustering by a bisector tournament.

Vectors become integers.  For a round, every pair of centroids (a < b) has its
bisector: the integer normal 2 (b - a) and the threshold |b|^2 - |a|^2.  A vector
whose product with the normal exceeds the threshold is nearer to b; zero favours
a, the smaller number.  Each of the k - 1 sign tests of a tournament eliminates one
centroid, so no distance is computed before the final one, to the winner, which is
exact.

A round is one pass over the stored vectors: a task adds up its vectors by winner
and hands on one row per centroid with exact totals, whatever the cluster's size, and
Spark adds those.  Only the centroids (k vectors) reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import stored
from gridscope.session import ship_package

K = 16
ROUNDS = 3
SCALE = 64
DIM = 64
SEED = "1"


def _safe(dim: int) -> int:
    """Components below this in size keep all sums of a test within 64 bits."""
    return math.isqrt(2 ** 59 // dim)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, exact."""
    return (a * b).sum(axis=1) if a.dtype == object or b.dtype == object else np.einsum("ij,ij->i", a, b)


def integers(vectors: DataFrame, column: str, dim: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<decimal(38,0) or long>) of the rows with ``dim`` components, all finite."""
    x = F.col(f"`{column}`")
    fine = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale).cast("double") * c.cast("double")))
    return stored(vectors.select("vec_id", F.when(fine, v).alias("v")).filter("v IS NOT NULL"), "cluster-vectors")


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.wide = max((abs(x) for c in centroids for x in c), default=0) >= _safe(len(centroids[0]))
        self.at = np.array(centroids, dtype=object if self.wide else np.int64)
        squares = (self.at * self.at).sum(axis=1)
        self.normals = 2 * (self.at[None, :, :] - self.at[:, None, :])  # [a, b]: towards b
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, v: np.ndarray) -> np.ndarray:
        """The nearest centroid of every row, ties to the smaller number."""
        best = np.zeros(len(v), np.int64)
        for b in range(1, len(self.at)):
            # One test a row: its winner so far (a smaller number) against b.
            best[(_dot(v, self.normals[best, b]) > self.thresholds[best, b]).astype(bool)] = b
        return best

    def distances(self, v: np.ndarray, best: np.ndarray) -> np.ndarray:
        off = v - self.at[best]
        return _dot(off, off)


def _matrix(column: pa.Array, dim: int, wide: bool) -> np.ndarray:
    """Rows of a list column; Python's integers where 64 bits might not hold a product."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    large = wide or (v.size and max(int(v.max()), -int(v.min())) >= _safe(dim))
    return v.astype(object) if large else v


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int]]]:
    """Per winner its number of vectors and exact componentwise sums."""
    total = pa.decimal128(38, 0)

    def run(batches):
        bisectors = Bisectors(centroids)
        counts, sums = [0] * len(centroids), np.zeros((len(centroids), dim), dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), dim, bisectors.wide)
            best = bisectors.winners(v)
            for k in np.unique(best):
                mine = v[best == k]
                counts[k] += len(mine)
                sums[k] += np.array([int(x) for x in mine.sum(axis=0)], dtype=object)
        held = [k for k, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([counts[k] for k in held], pa.int64()),
             pa.array([[str(x) for x in sums[k]] for k in held], pa.list_(pa.string())).cast(pa.list_(total))], names=["cluster", "n", "s"])

    parts = rows.select("v").mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>")
    parts = parts.select("cluster", "n", F.posexplode("s").alias("i", "x"))
    out: dict[int, tuple[int, list[int]]] = {}
    # At most k * dim rows.
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("cluster", "i").collect():
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["x"]))
    return out


def cluster(vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every usable row, the final centroids).

    Centroids start as the ``k`` rows with the smallest sha256 of ``seed:vec_id`` (ties,
    as of repeated ids: smaller vector first; a null id counts as empty text); fewer
    rows give fewer centroids.  Rows whose vector is null, has another number of
    components than ``dim``, or has a null or non-finite one take no part.  Repeated
    rows each take part.  Scaled components are exact within 64 bits (beyond that they
    are the nearest such integer); distances beyond 64 bits are null.  Without usable
    rows the result is empty.  Other columns are not read."""
    rows = integers(vectors, column, dim, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["v"]) for r in rows.select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()]
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        for at, (n, sums) in _sums(rows, centroids, dim).items():
            centroids[at] = [x // n for x in sums]

    def assign(batches):
        bisectors = Bisectors(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), dim, bisectors.wide)
            best = bisectors.winners(v)
            far = [int(x) if x < 2 ** 63 else None for x in bisectors.distances(v, best)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(far, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    schema = rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).schema
    return rows.mapInArrow(assign, schema), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with the sums of distances over the row's cluster and over all rows
    (null beyond 64 bits), and the sha256 of the cluster's centroid."""
    spark = assigned.sparkSession
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    fit = lambda x: x if x < 2 ** 63 else None
    every = sum(int(r["s"] or 0) for r in per)
    told = [(r["cluster"], fit(int(r["s"] or 0)), fit(every),
             hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in per]
    sums = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its cluster, distance and the clusters' inertia."""
    ship_package(spark)
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return with_inertia(stored(assigned, "clusters"), centroids)


def _rounds_sql(rounds: int) -> str:
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS (SELECT p.n, arg_min(c.cluster, (list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster)) AS cluster "
                   f"FROM p, c{r} c GROUP BY p.n)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT cluster, list(f ORDER BY i) AS v FROM (SELECT cluster, i, floor(sum(x) / count(*)) AS f "
                       f"FROM (SELECT a.cluster, unnest(range(1, {DIM + 1})) AS i, unnest(p.v) AS x FROM a{r} a JOIN p USING (n)) GROUP BY cluster, i) GROUP BY cluster)")
            out.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return ",\n".join(out)


OP11_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM p ORDER BY 1, 2 LIMIT {K})),
{_rounds_sql(ROUNDS)},
d AS (SELECT p.vec_id, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance,
        sha256(array_to_string(list_transform(c.v, lambda x: (x::BIGINT)::VARCHAR), ',')) AS centroid_sha256
      FROM a{ROUNDS} a JOIN p USING (n) JOIN c{ROUNDS} c USING (cluster))
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d
"""
