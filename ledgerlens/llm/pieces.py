"""Token ids of whole texts by the tokenizers library, with equal pieces encoded once.

A text is cut at spaces.  Where no piece is empty, begins or ends with white
space or has special-token strings, no token crosses a cut, so the ids of a
text are those of its pieces in order; other texts go to the library whole.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from functools import lru_cache

import numpy as np

#: Pieces that each of the two generations of a worker's cache holds.
CACHE_PIECES = 250_000
_LOADED: dict[str, PieceEncoder] = {}


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(dict(zip(printable, printable)).get(b, 256 + rest.index(b) if b in rest else b)) for b in range(256)]


class _Cache(dict):
    """Ids of pieces; a piece not held comes from the older generation or is made."""

    def __init__(self, make, old: dict | None = None):
        super().__init__()
        self.make, self.old = make, old or {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        self[piece] = got
        return got


class PieceEncoder:
    """Encodes as the library does; ``spaced``: a piece after a space carries that space (byte-level vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.spaced = self.library.normalizer is None
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.letters = dict(enumerate(byte_letters()))
        self.cache, self.starts = _Cache(self._make), _Cache(self._start)
        self.forms = [struct.Struct(f"<{n}{'HI'[self.dtype.itemsize > 2]}").pack for n in range(32)]

    def _ids(self, ids: list[int]) -> bytes:
        return self.forms[len(ids)](*ids) if len(ids) < 32 else np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._ids(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _make(self, piece: str) -> bytes | None:
        """Ids of one piece that follows a space; None where its neighbours may matter.
        A piece of letters alone is one word for the model."""
        if not piece.isalpha():
            if "\n" in piece:
                return self._lines(piece)
            core = piece.rstrip(".,;:!?")
            if core != piece and core.isalpha():
                return self.cache[core] + self._punctuation(piece[len(core):])
            if not piece or piece[0].isspace() or piece[-1].isspace() or "<|" in piece:
                return None
            return self._whole(" " + piece if self.spaced else piece)
        word = " " + piece
        if not self.spaced:
            word = piece.lower() if piece.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
            if not word.isalpha():
                return self._whole(piece)
        return self._word(word)

    def _lines(self, piece: str) -> bytes | None:
        """A piece over a line end: what is before it, then the line end with what follows."""
        before, after = piece.split("\n", 1)
        if not before or before[-1].isspace() or not after or after[0].isspace():
            return None if not before or not after or piece[0].isspace() or piece[-1].isspace() or "<|" in piece else self._whole(" " + piece if self.spaced else piece)
        head, tail = self.cache[before], (self.starts if self.spaced else self.cache)[after]
        return None if head is None or tail is None else head + tail

    def _start(self, piece: str) -> bytes | None:
        """Ids of a line end and a piece that follows it, where the vocabulary keeps line ends."""
        if piece.isalpha():
            return self._punctuation("\n") + self._word(piece)
        core = piece.rstrip(".,;:!?")
        if core != piece and core.isalpha():
            return self.starts[core] + self._punctuation(piece[len(core):])
        return None if piece[-1].isspace() or "<|" in piece else self._whole("\n" + piece)

    def _word(self, word: str) -> bytes:
        return self._ids([t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    @lru_cache(1024)
    def _punctuation(self, marks: str) -> bytes:
        return self._whole(marks)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian integers of ``dtype``; none for null."""
        if not text:
            return b""
        if len(self.cache) > CACHE_PIECES:
            self.cache.old = {}
            self.cache = _Cache(self._make, self.cache)
        if len(self.starts) > CACHE_PIECES // 8:
            self.starts.clear()
        first, *rest = text.split(" ")
        try:
            got = b"".join(map(self.cache.__getitem__, rest))
            if self.spaced:
                return (self._word(first) if first.isalpha() else self._whole(first)) + got
            return self.cache[first] + got
        except TypeError:  # a piece whose neighbours may matter
            return self._whole(text)


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
