"""Operator 9: exact duplicate substrings by bucket-pointer refinement.

Every byte that a ``LENGTH``-byte string covers which starts at two or more places
is removed.  Suffixes are never sorted whole: a string's place in the suffix
order only matters up to ``LENGTH`` bytes, so buckets are refined until they are
either single or agree that far.

*Bucket identifiers.*  A place's identifier for 2q bytes is made from its own
identifier for q bytes and that of the place q bytes later; the refined
identifiers are used again for the next round (1, 2, 4, ... bytes, any other
length by two overlapping ones).  Identifiers are content hashes, so no global
renumbering is needed.

*Places are handled in runs.*  All strings starting in a run share the smallest
q-byte identifier inside them, which is the run's bucket.  Equal strings always
fall into equal buckets; a bucket with one run is finished.  For the others:

1. runs with equal bodies repeat whole;
2. different bodies in one bucket are refined with longer identifiers
   (``GRAMS``), and in the end by the identifiers of the strings themselves.

Texts move once to the tasks that refine them (compressed), and only texts with a
shared bucket move again.  Equal texts are refined once, with their number.
Bucket sizes are counted before the shuffle and joined back one row a bucket, so
that hot buckets can be split; no bucket is gathered anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import documents, lean, stored

LENGTH = 200
#: Identifier lengths (bytes) of the rounds before the last, which uses LENGTH.
GRAMS = (64, 160)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


_BYTES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)
_OTHERS = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1001)) * _A)


def identifiers(raw: np.ndarray, q: int, start: np.ndarray = _BYTES) -> np.ndarray:
    """Identifiers of the q-byte strings at every place, by doubling from those of
    single bytes (``start``)."""
    h, have = start[raw], 1
    while 2 * have <= q:
        h = _mix(h[:-have] * _A + h[have:])
        have *= 2
    if have < q:
        h = _mix(h[:have - q] * _A + h[q - have:])
    return h


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum over w neighbours, by doubling."""
    have = 1
    while 2 * have <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:have - w], h[w - have:]) if have < w else h


def runs(raw: bytes, q: int, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, first place, number of places, loop) of the runs of a text.

    ``loop`` marks runs whose smallest identifier occurs again before the run
    ends; only these can hold equal strings at two places."""
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    ids = identifiers(np.frombuffer(raw, np.uint8), q)
    low = _smallest(ids, length - q + 1)
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    again = np.append((ids[:len(low) - 1] == low[:-1]) & (low[1:] == low[:-1]), False)
    return low[starts].view(np.int64), starts, np.diff(np.append(starts, len(low))), np.logical_or.reduceat(again, starts)


def _bodies(raw: bytes, starts, sizes, length: int) -> list[int]:
    import xxhash
    return [xxhash.xxh3_64_intdigest(raw[a:a + n + length - 1]) - 2 ** 63 for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def merged(starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs (starts, ends) covered by (first place, number of places)."""
    order = np.argsort(starts, kind="stable")
    a = starts[order].astype(np.int64)
    reach = np.maximum.accumulate(a + sizes[order] + length - 1)
    new = np.concatenate([[0], np.flatnonzero(a[1:] > reach[:-1]) + 1])
    return a[new], reach[np.append(new[1:], len(a)) - 1]


def cut(raw: bytes, starts, ends) -> bytes:
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _lists(values, kind) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _first_round(docs: DataFrame, q: int, length: int) -> DataFrame:
    """One row a document: rid, doc_id, tid (md5), n_bytes, sha256, buckets."""
    def run(batches):
        from pyspark import TaskContext
        rid = TaskContext.get().partitionId() << 32
        for b in batches:
            raws = [(t.as_py() or "").encode("utf-8") for t in b.column(1)]
            found = [runs(r, q, length) for r in raws]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(rid, rid + len(raws))), b.column(0),
                pa.array([hashlib.md5(r).digest() for r in raws], pa.binary()),
                pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()),
                _lists([f[0] for f in found], pa.int64()), _lists([f[0][f[3]] for f in found], pa.int64())],
                names=["rid", "doc_id", "tid", "n_bytes", "sha", "buckets", "loops"])
            rid += len(raws)

    return docs.mapInArrow(lean(run), f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, tid binary, n_bytes long, sha binary, "
                                "buckets array<long>, loops array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, z): texts compressed for their way through a shuffle."""
    def run(batches):
        press = zstandard.ZstdCompressor(3)
        for b in batches:
            raws = [(t.as_py() or "").encode("utf-8") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(r).digest() for r in raws], pa.binary()),
                                              pa.array([press.compress(r) for r in raws], pa.binary())], names=["doc_id", "tid", "z"])

    return docs.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, tid binary, z binary")


_RUNS = "buckets array<long>, bodies array<long>, starts array<int>, sizes array<int>, loops array<boolean>"


def _with_bodies(texts: DataFrame, q: int, length: int) -> DataFrame:
    """Per text (rid, copies, z, at: shared runs): those runs with body hashes."""
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for z, at in zip(b.column(2), b.column(3), strict=True):
                raw = zstandard.decompress(z.as_py())
                key, start, size, loop = (x[np.asarray(at.as_py())] for x in runs(raw, q, length))
                for c, v in zip(cols, (key, _bodies(raw, start, size, length), start, size, loop), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(_lists, cols, types)],
                                             names=["rid", "copies", "z", "buckets", "bodies", "starts", "sizes", "loops"])

    return texts.mapInArrow(lean(run), f"rid long, copies long, z binary, {_RUNS}")


def _cut_bodies(rows: DataFrame, length: int) -> DataFrame:
    """(rid, z, wanted: structs of bucket, start, size, single) to one row a body."""
    names = ["bucket", "start", "size", "single"]

    def run(batches):
        for b in batches:
            for rid, z, wanted in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw, wanted = zstandard.decompress(z.as_py()), wanted.values
                starts, sizes = (wanted.field(k).to_numpy() for k in ("start", "size"))
                cuts = [raw[a:a + n + length - 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), rid.as_py(), np.int64)), *(wanted.field(k) for k in names),
                                                  pa.array(cuts, pa.binary())], names=["rid", *names, "raw"])

    return rows.mapInArrow(lean(run), "rid long, bucket long, start int, size int, single boolean, raw binary")


#: Bytes of bodies that a task refines at once (one body at least).
AT_ONCE = 1_000_000


def _portions(b: pa.RecordBatch, column: str, most: int):
    """Slices of ``b`` with at most ``most`` bytes of a binary column, or one row."""
    upto = np.cumsum(pc.binary_length(b.column(column)).to_numpy())
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at)
        at = end


def _refined(bodies: DataFrame, q: int, length: int) -> DataFrame:
    """The runs inside each body for longer identifiers; ``parent`` is the body's
    place.  The old bucket is part of the new one: buckets are only split."""
    last = q >= length
    names = ["rid", "parent", "bucket", "body", "start", "size", "single", "loop"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())

    def run(batches):
        for b in (part for big in batches for part in _portions(big, "raw", AT_ONCE)):
            # Many bodies at once; places whose string would leave its body are left out.
            raws = b.column("raw").to_pylist()
            raw = b"".join(raws)
            buf = np.frombuffer(raw, np.uint8)
            ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
            offsets = np.concatenate([[0], ends[:-1]])
            sizes = ends - offsets - length + 1
            owner = np.repeat(np.arange(len(raws)), sizes)
            places = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[owner]
            ids = identifiers(buf, q)
            low = _smallest(ids, length - q + 1)[places]
            if last:  # one place each
                first, size = np.arange(len(places)), np.ones(len(places), np.int64)
                loop = np.zeros(len(places), bool)
                body = identifiers(buf, length, _OTHERS)[places].view(np.int64)
            else:
                same = (low[1:] == low[:-1]) & (owner[1:] == owner[:-1])
                first = np.concatenate([[0], np.flatnonzero(~same) + 1])
                size = np.diff(np.append(first, len(low)))
                loop = np.logical_or.reduceat(np.append((ids[places[:-1]] == low[:-1]) & same, False), first)
                body = np.asarray(_bodies(raw, places[first], size, length), np.int64)
            owner, bucket = owner[first], b.column("bucket").to_numpy()
            start = b.column("start").to_numpy()
            key = _mix(low[first] ^ _mix(bucket[owner].view(np.uint64) + _B)).view(np.int64)
            single = b.column("single").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                (b.column("rid").to_numpy()[owner], start[owner], key, body, places[first] - offsets[owner] + start[owner],
                 size, single[owner], loop), types, strict=True)], names=names)

    return bodies.mapInArrow(lean(run, 4_096), "rid long, parent int, bucket long, body long, start int, size int, single boolean, loop boolean")


def _kinds(one: DataFrame, copies, single, parent) -> DataFrame:
    """The different bodies of every bucket: how often, where first, and whether
    an occurrence is still undecided."""
    place = F.struct("rid", parent.alias("parent"), "start", "size")
    return one.groupBy("bucket", "body").agg(F.sum(copies).alias("k"), F.min(place).alias("place"), F.max(single).alias("open"),
                                             F.max("loop").alias("loop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, grams=GRAMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): the documents' rows, the compressed texts with a shared
    bucket, and per rid the (first place, number of places) of repeated strings.

    ``rid`` numbers rows; equal texts share the smallest one in ``units``."""
    docs = docs.select("doc_id", "text")
    rows = stored(_first_round(docs, grams[0], length), "rows")
    # One row per different text, with its number of copies.
    units = rows.groupBy("tid").agg(F.min_by(F.struct("doc_id", "rid"), "rid").alias("u"), F.count(F.lit(1)).alias("copies"))
    units = stored(units.select("tid", F.col("u.doc_id").alias("d"), F.col("u.rid").alias("rid"), "copies"), "units")
    shared = rows.select(F.explode(F.concat("buckets", "loops")).alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket")
    every = rows.select("rid", F.posexplode("buckets").alias("at", "bucket"))
    live = every.join(shared, "bucket").groupBy("rid").agg(F.collect_list("at").alias("at")).join(units, "rid")
    packed = _packed(docs)
    if rows.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").head(1):
        packed = packed.dropDuplicates(["doc_id", "tid"])
    texts = live.join(packed, (live["tid"] == packed["tid"]) & live["d"].eqNullSafe(packed["doc_id"]))
    texts = stored(_with_bodies(texts.select("rid", "copies", "z", "at"), grams[0], length), "texts")
    one = texts.select("rid", "copies", F.explode(F.arrays_zip("buckets", "bodies", "starts", "sizes", "loops")).alias("r")).select(
        "rid", "copies", F.col("r.buckets").alias("bucket"), F.col("r.bodies").alias("body"), F.col("r.starts").alias("start"),
        F.col("r.sizes").alias("size"), F.col("r.loops").alias("loop"))
    kinds = stored(_kinds(one, F.col("copies"), F.lit(True), F.col("start")), "kinds")
    whole = kinds.filter("k > 1").select("bucket", "body")
    spans = [stored(one.join(whole, ["bucket", "body"]).select("rid", "start", "size"), "spans")]
    bodies = None
    for q in (*grams[1:], length):
        # Different bodies in one bucket: one of each goes on.
        mixed = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("loop").alias("loop")).filter("n > 1 OR loop").select("bucket")
        wanted = kinds.join(mixed, "bucket").select("bucket", "place.*", (F.col("open") & (F.col("k") == 1)).alias("single"))
        if bodies is None:
            by_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("bucket", "start", "size", "single")).alias("wanted"))
            bodies = _cut_bodies(texts.select("rid", "z").join(by_text, "rid"), length)
        else:
            whole_body = bodies.select("rid", F.col("start").alias("parent"), F.col("raw").alias("all"))
            bodies = wanted.join(whole_body, ["rid", "parent"]).select(
                "rid", "bucket", "start", "size", "single", F.substr("all", F.col("start") - F.col("parent") + 1, F.col("size") + (length - 1)).alias("raw"))
        bodies = stored(bodies, "bodies")
        one = stored(_refined(bodies, q, length), "refined")
        kinds = stored(_kinds(one, F.lit(1), F.col("single"), F.col("parent")), "kinds")
        whole = kinds.filter("k > 1 AND open").select("bucket", "body")
        spans.append(stored(one.filter("single").join(whole, ["bucket", "body"]).select("rid", "start", "size"), "spans"))
    every_span = spans[0]
    for s in spans[1:]:
        every_span = every_span.union(s)
    return rows.drop("buckets", "loops").join(units.select("tid", F.col("rid").alias("unit")), "tid"), texts.select("rid", "z"), every_span


def dedup_substrings(docs: DataFrame, length: int = LENGTH, grams=GRAMS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    ``spans``, the removed byte runs (start, end).

    Null texts count as empty; texts shorter than ``length`` bytes lose nothing.
    Rows with equal texts count as separate places, also when they are repeated
    whole, and lose every string of ``length`` bytes.  An empty table gives an
    empty one; other columns are not read."""
    rows, texts, spans = repeated_spans(docs, length, grams)
    lists = spans.groupBy("rid").agg(F.collect_list("start").alias("s"), F.collect_list("size").alias("n"))

    def run(batches):
        for b in batches:
            removed, shas = [], []
            for z, s, n in zip(b.column(1), b.column(2), b.column(3), strict=True):
                starts, ends = merged(s.values.to_numpy(), n.values.to_numpy(), length)
                removed.append([{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
                shas.append(hashlib.sha256(cut(zstandard.decompress(z.as_py()), starts, ends)).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.binary()), pa.array(
                removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["unit", "kept", "spans"])

    done = texts.join(lists, "rid").select("rid", "z", "s", "n").mapInArrow(
        run, "unit long, kept binary, spans array<struct<start:long,end:long>>")
    out = rows.join(done, "unit", "left")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", F.coalesce(gone, F.lit(0)).alias("n_removed"),
                      F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"), "spans")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 200-byte strings."""
    return dedup_substrings(documents(spark, sf_dir, "doc_id", "text")).drop("spans")
