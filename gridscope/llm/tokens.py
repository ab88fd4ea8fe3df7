"""Operator 2: token counts without token ids.

1. Blocks of documents are split into pre-tokens; a block keeps its distinct
   pre-tokens once and, per document, (pre-token number, frequency) pairs.
2. The distinct pre-tokens of all blocks meet in one shuffle, and the pieces of
   each are counted once.
3. The counts go back to their blocks, packed (as many as the block has distinct
   pre-tokens), and are joined to the block; a document's
   tokens are the sum of count times frequency.

Only dictionaries are shuffled, not (document, pre-token) rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm import pretokens
from gridscope.llm.common import documents, stored

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Characters after which a block of documents is closed.
BLOCK_CHARS = 32_000_000
#: Counts that a task holds before it hands them on, packed per block.
HELD = 1_000_000


def _blocks(docs: DataFrame, name: str, block_chars: int) -> DataFrame:
    """One row per block: ids, sizes, the distinct pre-tokens, and ``pairs``, the
    compressed (pre-token number, frequency) pairs with each document's count."""
    text_at = docs.columns.index("text")
    id_at = docs.columns.index("doc_id")

    def run(batches):
        from pyspark import TaskContext
        block, chars = TaskContext.get().partitionId() << 32, 0
        known, ids, sizes, counts, steps, freqs = {}, [], [], [], [], []

        def closed():
            pairs = zstandard.compress(b"".join(x.tobytes() for x in (
                np.asarray(counts, "<u4"), np.concatenate(steps).astype("<u4"), np.concatenate(freqs).astype("<u4"))))
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([pairs], pa.binary()),
                pa.array([list(known)], pa.list_(pa.string()))], names=["block", "doc_id", "n_bytes", "pairs", "pretokens"])

        for b in batches:
            for doc, text in zip(b.column(id_at), b.column(text_at), strict=True):
                text = text.as_py() or ""
                parts = pretokens.split(text, name)
                numbers = np.fromiter((known.setdefault(p, len(known)) for p in parts), np.int64, len(parts))
                code, freq = np.unique(numbers, return_counts=True)
                ids.append(doc.as_py())
                sizes.append(len(text.encode("utf-8")))
                counts.append(len(code))
                steps.append(np.diff(code, prepend=0))
                freqs.append(freq)
                chars += len(text)
                if chars >= block_chars:
                    yield closed()
                    block, chars = block + 1, 0
                    known, ids, sizes, counts, steps, freqs = {}, [], [], [], [], []
        if ids:
            yield closed()

    return docs.mapInArrow(run, "block long, doc_id array<long>, n_bytes array<long>, pairs binary, pretokens array<string>")


def _piece_counts(pre: DataFrame, name: str) -> DataFrame:
    """(block, part): compressed (code, pieces) arrays.  Equal pre-tokens stand next
    to each other in one task (at most one row a block), so that each is counted
    once."""
    def run(batches):
        tok, last, count = pretokens.tokenizer(name), None, 0
        held: list[list[np.ndarray]] = [[], [], []]

        def packed():
            blocks, codes, pieces = (np.concatenate(h) for h in held)
            for h in held:
                h.clear()
            order = np.lexsort((codes, blocks))
            blocks, codes, pieces = blocks[order], codes[order], pieces[order]
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            parts = [zstandard.compress(np.concatenate([np.diff(c, prepend=0), p]).astype("<u4").tobytes())
                     for c, p in zip(np.split(codes, cuts), np.split(pieces, cuts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks[np.concatenate([[0], cuts])]), pa.array(parts, pa.binary())], names=["block", "part"])

        for b in batches:
            words = b.column(2).to_pylist()
            new = [w for w, v in zip(words, [last, *words], strict=False) if w != v]
            sizes = iter([len(e) for e in tok.encode_batch_fast(new, add_special_tokens=False)])
            pieces = np.empty(len(words), np.int64)
            for k, w in enumerate(words):
                if w != last:
                    last, count = w, next(sizes)
                pieces[k] = count
            if len(words):
                for h, v in zip(held, (b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), pieces), strict=True):
                    h.append(v)
            if sum(map(len, held[0])) >= HELD:
                yield packed()
        if held[0]:
            yield packed()

    together = pre.repartition("pretoken").sortWithinPartitions("pretoken")
    return together.mapInArrow(run, "block long, part binary")


def _unpacked(parts: list[bytes]) -> np.ndarray:
    """Pieces by code, from a block's (code steps, pieces) arrays."""
    codes, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in parts:
        raw = np.frombuffer(zstandard.decompress(p), "<u4").astype(np.int64)
        codes.append(np.cumsum(raw[:len(raw) // 2]))
        pieces.append(raw[len(raw) // 2:])
    out = np.zeros(sum(map(len, codes)), np.int64)
    out[np.concatenate(codes)] = np.concatenate(pieces)
    return out


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``doc_id`` must be a 64-bit integer (null allowed).  Null and empty texts
    have 0 bytes and 0 tokens.  Repeated rows give repeated results; an empty
    table gives an empty one; other columns are not read."""
    blocks = stored(_blocks(docs.select("doc_id", "text"), name, block_chars), "token-blocks")
    pre = blocks.select("block", F.posexplode("pretokens").alias("code", "pretoken"))
    counts = _piece_counts(pre, name).groupBy("block").agg(F.collect_list("part").alias("parts"))
    both = blocks.select("block", "doc_id", "n_bytes", "pairs").join(counts, "block", "left")

    def run(batches):
        for b in batches:
            for ids, sizes, pairs, parts in zip(*(b.column(c) for c in ("doc_id", "n_bytes", "pairs", "parts")), strict=True):
                each = _unpacked(parts.as_py() or [])
                raw = np.frombuffer(zstandard.decompress(pairs.as_py()), "<u4").astype(np.int64)
                n = len(ids)
                ends = np.cumsum(raw[:n])
                total = int(ends[-1])
                steps, freqs = raw[n:n + total], raw[n + total:]
                starts = ends - raw[:n]
                upto = np.cumsum(steps)
                codes = upto - np.repeat(np.concatenate([[0], upto])[starts], raw[:n])
                sums = np.concatenate([[0], np.cumsum(each[codes] * freqs)])
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(sums[ends] - sums[starts])],
                                                 names=["doc_id", "n_bytes", "n_tokens"])

    out = both.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(documents(spark, sf_dir, "doc_id", "text"))
