"""Operator 5: bounded-space online packing into fixed-size sequences.

Each partition keeps ``OPEN`` windows.  A document's whole windows go out alone;
its rest is placed best-fit.  When none fits, the fullest window is emitted: the
head of the arriving rest fills its gap, unless the gap is a sliver shorter than
``SLIVER`` tokens.  At the end a partition merges its open windows into full ones,
and the one part-filled window of each partition is merged with those of ``FAN``
others, level by level, until one is left.  That last one is cut at powers of two,
so it needs no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm import pretokens
from gridscope.llm.common import documents, lean, stored

TOKENIZER = "word_bpe_49k.json"
SIZE = 2048
END_ID = 1
OPEN = 32
SLIVER = 16
FAN = 64

# A piece in the making: (doc_id, start, doc_tokens, ids as bytes).
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
_TYPES = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "ids binary, part long")


def _cut(piece, n: int):
    """The first ``n`` tokens of a piece, and the rest."""
    doc, start, total, ids = piece
    return (doc, start, total, ids[:4 * n]), (doc, start + n, total, ids[4 * n:])


class Windows:
    """Open windows of one partition; ``done`` holds finished ones."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most, self.fills, self.held, self.done, self.n = size, open_windows, [], {}, [], 0

    def place(self, piece) -> None:
        while len(piece[3]) >= 4 * self.size:
            head, piece = _cut(piece, self.size)
            self.done.append([head])
        while n := len(piece[3]) // 4:
            at = bisect_right(self.fills, (self.size - n, float("inf"))) - 1
            if at >= 0:
                fill, key = self.fills.pop(at)
                self.held[key].append(piece)
                if fill + n == self.size:
                    self.done.append(self.held.pop(key))
                else:
                    insort(self.fills, (fill + n, key))
                return
            if len(self.fills) < self.most:
                self.n += 1
                self.held[self.n] = [piece]
                insort(self.fills, (n, self.n))
                return
            fill, key = self.fills.pop()
            if self.size - fill >= SLIVER:
                head, piece = _cut(piece, self.size - fill)
                self.held[key].append(head)
            self.done.append(self.held.pop(key))

    def rest(self) -> list:
        """The pieces of the windows still open, fullest window first."""
        return [p for _, key in reversed(self.fills) for p in self.held[key]]


def merged(pieces: list, size: int) -> tuple[list, list]:
    """Full windows from the pieces one after the other, and the last, part-filled one."""
    full, now, fill = [], [], 0
    for p in pieces:
        while p[3]:
            head, p = _cut(p, min(size - fill, len(p[3]) // 4))
            now.append(head)
            fill += len(head[3]) // 4
            if fill == size:
                full.append(now)
                now, fill = [], 0
    return full, now


def powers(pieces: list, size: int) -> list:
    """The pieces of one part-filled window as windows of powers of two."""
    out, left = [], sum(len(p[3]) for p in pieces) // 4
    while left:
        n = 1 << (left.bit_length() - 1)
        full, rest = merged(pieces, n)
        out.append(full[0])
        pieces = [p for w in full[1:] for p in w] + rest
        left -= n
    return out


def _rows(windows: list, first: int, part: int, with_ids: bool) -> dict:
    """Columns for windows numbered from ``first``; ``part`` below 0: finished."""
    cols: dict = {n: [] for n in _NAMES}
    for k, w in enumerate(windows):
        offset = 0
        for doc, start, total, ids in w:
            n = len(ids) // 4
            for name, v in zip(_NAMES, (doc, start, n, zlib.crc32(ids), total, first + k, offset,
                                        ids if with_ids or part >= 0 else None, part), strict=True):
                cols[name].append(v)
            offset += n
    return cols


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _merger(size: int, level: int, last: bool, with_ids: bool):
    """Merge the part-filled windows of one group (at most ``FAN`` of them)."""
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        pieces = list(zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True))
        full, rest = merged(pieces, size)
        if last:
            full, rest = full + powers(rest, size), []
        group = key[0].as_py()
        return pa.Table.from_batches([_batch(_rows(full, (level << 56) + (group << 32), -1, with_ids)),
                                      _batch(_rows([rest], 0, group, with_ids))])

    return merge


def pack(docs: DataFrame, name: str = TOKENIZER, size: int = SIZE, open_windows: int = OPEN,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and its ids (32-bit little-endian) if ``with_ids``.

    ``doc_id`` is a 64-bit integer (null allowed).  A null or empty text is the
    end id alone.  Repeated rows are packed as often as they occur.  An empty
    table gives an empty one; other columns are not read."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder, windows, n = pretokens.encoder(name), Windows(size, open_windows), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                windows.place((doc, 0, len(ids) // 4, ids))
            yield _batch(_rows(windows.done, (part << 32) + n, -1, with_ids))
            n += len(windows.done)
            windows.done = []
        full, rest = merged(windows.rest(), size)
        yield _batch(_rows(full, (part << 32) + n, -1, with_ids))
        yield _batch(_rows([rest], 0, part, with_ids))

    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _SCHEMA), "pieces")
    ready = [pieces.filter("part < 0")]
    left = pieces.filter("part >= 0")
    most, level = left.agg(F.max("part")).first()[0], 1
    while most is not None:
        last = most < FAN
        merge = _merger(size, level, last, with_ids)
        out = stored(left.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(merge, _SCHEMA), "pieces")
        ready.append(out.filter("part < 0"))
        left = out.filter("part >= 0")
        most, level = (None if last else most // FAN), level + 1
    all_pieces = ready[0]
    for r in ready[1:]:
        all_pieces = all_pieces.unionByName(r)
    return all_pieces.drop("part") if with_ids else all_pieces.drop("part", "ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return pack(documents(spark, sf_dir, "doc_id", "text"))
