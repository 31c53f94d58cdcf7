"""Token ids by a public tokenizer file, with a bounded cache of word encodings."""

from __future__ import annotations

import os
import string
import unicodedata
from array import array

#: Words kept per worker; words that do not fit are encoded each time they occur.
CACHE_WORDS = 250_000
CACHE_WORD_BYTES = 40
#: Below this code point, lower-casing and letter classes do not vary by library.
LATIN_END = "ɐ"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids by piece; missing ones are encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        ids = self._encode(piece)
        if len(self) < CACHE_WORDS and len(piece) <= CACHE_WORD_BYTES:
            self[piece] = ids
        return ids


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes.

    The vocabulary lower-cases, drops white space before its merges, and no merge crosses it,
    so the ids of a text are the concatenated ids of its pieces between spaces; pieces repeat,
    and their ids are cached.  Pieces made of Latin letters, with closing punctuation or
    none, go straight to the merge model; all others through the whole tokenizer.  The
    result equals ``encode(text, add_special_tokens=False)`` of the file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._merge = self._tok.model.tokenize
        chars = _byte_chars()
        self._table = [chars[b] for b in range(256)]
        self._close = {c: self._whole(c) for c in string.punctuation}
        self._ids = _Pieces(self._piece).__getitem__

    def _whole(self, piece: str) -> bytes:
        return array("I", self._tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        s = piece.decode()
        stem, tail = s.rstrip(string.punctuation), b""
        if stem != s and stem.isalpha():  # the closing marks are one piece of their own
            marks, s = s[len(stem):], stem
            tail = self._close[marks] if marks in self._close else self._ids(marks.encode())
        if s.isalpha() and max(s) < LATIN_END and "İ" not in s and unicodedata.is_normalized("NFC", s):
            if not s.isascii():
                table = self._table
                s = "".join([table[b] for b in s.lower().encode()])
            return array("I", [t.id for t in self._merge(s)]).tobytes() + tail
        return self._whole(s) + tail

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:  # special strings are found before lower-casing
            return self._whole(text)
        return b"".join(map(self._ids, text.encode().lower().split()))
