import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridscope.llm import packing, pretokens, tokens

NAME = tokens.TOKENIZER
ODD = ["", None, "'s it's I'LL don't", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "naïve ÀÉ ß ÿ ÷×", "x\x1cy\x85z\xa0w²³½ª",
       "日本語 テスト", "İstanbul Σας", "café", "a_b__c 12 345", "!!!'s 're", "\x00\x01 a\x7fb", " \n\t ", "word " * 9000]


def ids_of(text):
    return pretokens.tokenizer(NAME).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(sample):
    encoder = pretokens.Encoder(NAME)
    for text in ODD + [r.text for r in sample.collect()]:
        want = ids_of(text)
        assert encoder.encode(text or "") == np.asarray(want, "<u4").tobytes()
        assert sum(len(ids_of(p)) for p in pretokens.split(text or "", NAME)) == len(want)


def test_token_counts_equal_library(docs_of, sample, with_clashes):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in sample.collect()] + [(None, "null id"), (3, "twice"), (3, "twice")]
    got = tokens.token_counts(with_clashes(docs_of(rows)), block_chars=50_000).collect()
    want = sorted(((d, len((t or "").encode()), len(ids_of(t))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_token_counts_empty(docs_of):
    assert tokens.token_counts(docs_of([])).count() == 0


def check_pack(rows, pieces, size):
    """Every id in one piece; sequences gapless and within size.  Returns the padding."""
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == {d for d, _ in rows}
    for d, text in rows:
        ids, at = ids_of(text) + [1], 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start:at], "<u4").tobytes())
        assert at == len(ids)
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding / sum(p.length for p in pieces)


@pytest.mark.parametrize("size,parts", [(2048, 3), (64, 5)])
def test_packing(docs_of, sample, with_clashes, size, parts):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in sample.collect()] + [(None, "null id")]
    pieces = packing.pack(with_clashes(docs_of(rows, parts)), size=size, open_windows=4).collect()
    assert check_pack(rows, pieces, size) < 0.2 * packing.SLIVER / 64 + 0.01


def test_packing_merges_over_levels(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    rows = [(k, "some words here " * (k % 7)) for k in range(60)]
    pieces = packing.pack(docs_of(rows, 7), size=128).collect()
    assert check_pack(rows, pieces, 128) < 0.05
    assert packing.pack(docs_of([])).count() == 0


def test_packing_repeated_rows_and_ids(docs_of):
    pieces = packing.pack(docs_of([(1, "a b c"), (1, "a b c")], 1), with_ids=True).collect()
    assert sum(p.length for p in pieces) == 2 * (len(ids_of("a b c")) + 1)
    assert all(len(p.ids) == 4 * p.length for p in pieces)
