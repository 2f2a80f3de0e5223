"""Exact and fast byte-level BPE encoding with the tokenizers library.

A byte-level BPE first splits a text into pieces and merges within each piece
only. A piece never reaches over a single space between two characters that
are not white space, so a text can be cut before such spaces and every
distinct chunk needs the library once; repeated words come from a bounded
cache. Texts with rarer white space, control characters or the special token's
string, and those with letters beyond U+024F, whose classes differ between
Unicode versions, go through the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import regex

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
_ODD = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\xa0\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
_WHOLE = ("  ", " \n", " \t", "<|endoftext|>")
#: Bytes that only characters up to U+024F have: printable ASCII, \t, \n, what follows a lead byte, and the lead bytes from U+00C0 on.
_USUAL = bytes([9, 10, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
#: The pre-tokenizer's rule of byte-level vocabularies of this kind (fixed values).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_encoders: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the
    others as the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Pieces(dict):
    """piece -> little-endian ids of it; merges what it has not met. Two
    generations of at most `most` entries bound the memory."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.model, self.letters, self.most, self.old = tokenizer.model, _byte_letters(), most, {}

    def make(self, piece: str) -> bytes:
        if piece[:1] == " " and piece[1:].isascii() and piece[1:].isalpha():
            piece = self.letters[32] + piece[1:]
        else:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class _Chunks(_Pieces):
    """word -> ids of " word", by way of its pieces."""

    def __init__(self, tokenizer, most: int):
        super().__init__(tokenizer, most)
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer, most // 2)

    def make(self, word: str) -> bytes:
        if word.isalpha():
            return super().make(" " + word)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(" " + word)))


class Encoder:
    """most: distinct chunks of a generation, a memory bound only."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.tokenizer, most)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def odd(text: str) -> bool:
        """Whether text has one of the characters that need the library as a whole;
        most texts are cleared by deleting the bytes that cannot be part of one."""
        left = text.encode().translate(None, _USUAL)
        return bool(left) and _ODD.search(text) is not None

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(w in text for w in _WHOLE) or not (text.isascii() and text.isprintable()) and self.odd(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        head = b"".join(map(self.chunks.pieces.__getitem__, _PIECE.findall(first)))
        return head + b"".join(map(self.chunks.__getitem__, rest))


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
