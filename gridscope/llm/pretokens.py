"""Pre-tokens of a public ``tokenizers`` file and the pieces of each.

A text is the concatenation of its pre-tokens' pieces, so the work is done once
per distinct pre-token.  Texts made of common Latin characters are split by one
regular expression that equals the file's own rule on those characters; every
other text goes through the library's normalizer and pre-tokenizer.  Special
strings are cut out first, as the library does by default.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

assert sys.byteorder == "little" and array("I").itemsize == 4

#: Pre-tokens, and chunks of text, remembered by one Python worker; beyond it the
#: memory starts anew.
REMEMBERED = 900_000

# The file's split rule, written for lower-case Latin text.
_SPLIT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")


@functools.cache
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def _specials(name: str):
    texts = sorted((t.content for t in tokenizer(name).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, texts)) + ")") if texts else None


def _by_library(tok, text: str) -> list[str]:
    norm = tok.normalizer.normalize_str(text)
    return [norm[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(norm)]


def split(text: str, name: str) -> list[str]:
    """The pre-tokens of a text, in order (special strings as themselves)."""
    rule = _specials(name)
    out: list[str] = []
    parts = rule.split(text) if rule and "<|" in text else [text]
    for k, part in enumerate(parts):
        if k % 2:
            out.append(part)
        elif part:
            out += _by_library(tokenizer(name), part) if _OTHER.search(part) else _SPLIT.findall(part.lower())
    return out


class _Pieces(dict):
    """Pre-token to its ids, as little-endian 32-bit bytes."""

    def __init__(self, name: str):
        self.name = name

    def __missing__(self, pretoken: str) -> bytes:
        got = self[pretoken] = array("I", tokenizer(self.name).encode(pretoken, add_special_tokens=False).ids).tobytes()
        return got


class _Chunks(dict):
    """Lower-case text between white space to its ids; no pre-token crosses white space."""

    def __init__(self, pieces: _Pieces):
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        pieces = self.pieces
        got = self[chunk] = b"".join([pieces[p] for p in _SPLIT.findall(chunk)])
        return got


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, name: str):
        self.name, self.pieces = name, _Pieces(name)
        self.chunks = _Chunks(self.pieces)

    def encode(self, text: str) -> bytes:
        if "<|" in text or _OTHER.search(text):
            return array("I", tokenizer(self.name).encode(text, add_special_tokens=False).ids).tobytes()
        for known in (self.chunks, self.pieces):
            if len(known) > REMEMBERED:
                known.clear()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


@functools.cache
def encoder(name: str) -> Encoder:
    """The worker's own encoder; it remembers pieces over tasks."""
    return Encoder(name)
