"""Exact, cached encoding with the tokenizers library.

Both vocabularies split a text into pieces first and merge within pieces only,
so a piece is merged once by the library's own model and its ids are kept. Texts
of Latin letters, digits, ASCII white space and punctuation are split here by the
vocabulary's own rule, which on these characters needs no Unicode tables. Other
texts are cut where text changes to white space, which always ends a piece, and
each chunk takes the library's whole pipeline; texts with white space other than
space, \\t, \\n, \\r go uncut, as their runs of white space can't be cut safely.
Both caches are bounded (two generations).
"""

from __future__ import annotations

import os
import re
from array import array

#: Entries of a cache's generation; the byte vocabulary's pieces keep their space and case, so there are more of them.
GENERATION = {True: 300_000, False: 400_000}
SLICE = 1 << 20
_OTHER = re.compile("[^\t\n\r -~¡§«¶·»¿×÷À-ÖØ-öø-ÿ‐-‧‰-⁞€]")
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_CUT = re.compile(r"[^ \n\t\r](?=[ \n\t\r])")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACED = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Kept(dict):
    """Values by key, made on a miss; the least used half goes when a generation is full."""

    def __init__(self, make, size: int):
        self.make, self.old, self.size = make, {}, size

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes. words: the vocabulary drops white space and lower-cases."""

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.words, self.letters = words, _byte_letters()
        self.pieces, self.chunks = _Kept(self._piece, GENERATION[words]), _Kept(self.whole, GENERATION[words])

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = self.letters
        mapped = "".join([letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.library.model.tokenize(mapped)]).tobytes()

    def _slice(self, text: str) -> bytes:
        if not _OTHER.search(text):
            return b"".join(map(self.pieces.__getitem__, _WORDS.findall(text.lower()) if self.words else _SPACED.findall(text)))
        return b"".join(map(self.chunks.__getitem__, text.split() if self.words else _CHUNK.findall(text)))

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        if len(text) <= SLICE:
            return self._slice(text)
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE)
            end = cut.end() if cut else len(text)
            out.append(self._slice(text[at:end]))
            at = end
        return b"".join(out)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """One encoder per Python worker, so that its cache outlives a batch."""
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]
