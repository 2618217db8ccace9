"""Token ids of whole texts, by the ``tokenizers`` library, with a bounded cache of text pieces.

A tokenizer of this library splits a text into pre-tokens first and merges inside each of
them.  Both vocabularies used here never build a pre-token across an isolated white-space
character, so a text can be cut there, and each distinct piece is encoded only once per
worker.  Texts that hold an added token (``<|endoftext|>``) go to the library whole.  The tests compare the
ids with whole-text encoding by the library as it is, on odd texts.

* byte-level vocabulary (GPT-2 pattern): a single space between two other characters starts
  the next pre-token, so all pieces but the first carry a leading space; a single line end
  between two other characters is a pre-token;
* lower-casing word vocabulary: white space is dropped, so any white space separates pieces.

In both a piece of Latin-1 letters (with the space before it) is one pre-token, which neither normal form nor
pattern changes but for its case: it goes straight to the library's merges.

Texts of Latin-1 characters are lower-cased before they are cut where the vocabulary lower-cases: they are their own normal
form in either case, so words that differ by case alone are one piece.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CACHE_PIECES = 800_000  # in each of two generations, about 0.2 kB a piece
_ISOLATED = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?#$%&*|"
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


class _Touching(Exception):
    """A piece with white space at its edge: the space before or after it is not isolated."""


class _Cache(dict):
    """Piece -> ids, in two generations: when the young one is full it becomes the old one.

    Only a cache: what has dropped out is encoded again.  ``before`` is put before a piece.  With ``after_line`` (the cache
    of pieces without anything before them) pieces are cut at single line ends.
    """

    def __init__(self, encode, before: str, limit: int, after_line: _Cache | None = None):
        super().__init__()
        self.encode, self.before, self.limit, self.old, self.after_line = encode, before, limit, {}, after_line
        self.marks = functools.lru_cache(maxsize=1000)(encode)

    def _lines(self, piece: str) -> bytes | None:
        """The ids of a piece of several lines, which is not kept itself; None where a line end is not a single one."""
        first, *rest = piece.split("\n")
        if not first or first[0].isspace() or first[-1].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in rest):
            return None
        line_end = self.marks("\n")
        return b"".join((self[first], *(line_end + self.after_line[p] for p in rest)))

    def __missing__(self, piece: str) -> bytes:
        if self.after_line is not None and "\n" in piece:
            ids = self._lines(piece)
            if ids is not None:
                return ids
        ids = self.old.get(piece)
        if ids is None:
            if self.before and (not piece or piece[0].isspace() or piece[-1].isspace()):
                raise _Touching
            word = piece.rstrip(_MARKS)
            if len(word) < len(piece) and word[-1:].islower() and unicodedata.category(word[-1])[0] == "L":
                # Marks after a lower-case letter (which lower-casing leaves alone) are pre-tokens of their own; circled
                # letters and U+0345 are lower case too, but no letters: the word pattern joins them with the marks.
                ids = self[word] + self.marks(piece[len(word) :])
            else:
                ids = self.encode(self.before + piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _byte_characters() -> dict[int, int]:
    """The character that stands for a byte in a byte-level vocabulary, where it is not the Latin-1 one."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_CHARACTERS = _byte_characters()
_SPACE = chr(_BYTE_CHARACTERS[0x20])


def _ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    if _NATIVE:
        return array("I", ids).tobytes()
    return np.asarray(ids, dtype="<u4").tobytes()


def _latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceEncoder:
    """Texts to little-endian unsigned 32-bit ids (as bytes)."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        self._spaced = pre["type"] == "ByteLevel"
        if self._spaced and (spec["normalizer"] is not None or pre["add_prefix_space"] or not pre["use_regex"]):
            raise ValueError("pieces are only exact for a plain byte-level tokenizer")
        if not self._spaced and spec["model"].get("end_of_word_suffix") is None:
            raise ValueError("pieces are only exact where white space is dropped")
        self.vocabulary = self._tokenizer.get_vocab_size()
        self._added = [t["content"] for t in spec["added_tokens"]]
        self._lower = not self._spaced
        self._merge = self._merges(spec)
        after_line = _Cache(self._piece, "", cache_pieces // 4) if self._spaced else None
        self._cache = _Cache(self._piece, " " if self._spaced else "", cache_pieces, after_line)

    def _merges(self, spec: dict):
        """The library's merges inside a pre-token; None where letters may not be a pre-token as they are."""
        model, pre = spec["model"], spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        normal = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        if model["type"] != "BPE" or model["dropout"] or parts[-1]["type"] != "ByteLevel" or parts[-1]["add_prefix_space"]:
            return None
        if self._lower and (normal != {"NFC", "Replace", "Lowercase"} or len(parts) != 2 or r"|[\p{L}]+|" not in parts[0]["pattern"]["Regex"]):
            return None
        return self._tokenizer.model.tokenize

    def _piece(self, text: str) -> bytes:
        if self._merge is None or not _LETTERS.fullmatch(text):
            return self._direct(text)
        if self._lower:
            text = text.lower().lstrip(" ")
        if text.isascii():  # letters stand for themselves
            text = text.replace(" ", _SPACE)
        else:
            text = text.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return _ids([t.id for t in self._merge(text)])

    def _direct(self, text: str) -> bytes:
        return _ids(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        known = self._cache.__getitem__
        pieces = text.lower() if self._lower and _latin_1(text) else text
        if any(t in text or t in pieces for t in self._added):  # lower-casing may make one that the library does not see
            return self._direct(text)
        if not self._spaced:
            if any(c in text for c in _CONTROLS):  # Python's white space, not the tokenizer's
                return self._direct(text)
            return b"".join(map(known, pieces.split()))
        first, space, rest = text.partition(" ")
        if first and not first[-1].isspace():
            try:
                return self._direct(first) + b"".join(map(known, rest.split(" ") if space else ()))
            except _Touching:
                pass
        parts = _ISOLATED.split(text)
        if len(parts) == 1:
            return self._direct(text)
        return self._direct(parts[0]) + b"".join(map(known, parts[1:-1])) + self._direct(" " + parts[-1])

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order."""
        return map(self.encode, texts.to_pylist())


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary file."""
    return PieceEncoder(path)
