"""Token ids of whole texts, a piece at a time.

Both tokenizer files cut a text at white space before any merge, so the ids of a text are the ids of its
pieces in order. Most pieces of a corpus repeat; each Python worker keeps the ids of the pieces it met
lately (two generations of bounded size), as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

from . import common

#: Pieces in each of a cache's two generations.
GENERATION = 200_000
#: Longer pieces (one "word" of many kilobytes) are encoded but not kept.
LONGEST_KEPT = 64
DOUBLE_SPACE = re.compile(r"\s\s")
BEFORE_WORD = re.compile(r" (?=\S)")
#: A word of Latin letters, then marks that every pre-tokenizer here parts from it.
WORD_AND_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-įĲ-ſ]+)([.,;:!?*&$%#|]*)")


class PieceCache(dict):
    """piece -> bytes of its ids; `encode` is asked for pieces that aren't kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= GENERATION:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def u32(ids) -> bytes:
    return array("I", ids).tobytes()


#: Byte-level BPE writes each byte as one character; printable ones stand for themselves.
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _plain)}


def byte_chars(text: str) -> str:
    return text.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARS)


class SpacedEncoder:
    """Byte-level BPE whose pre-tokens take the space before them.

    A space before a word always begins a new pre-token. A line break between two words is one of its own;
    where white space runs together, only the space before a word is a safe cut. `word` encodes one
    pre-token in byte characters, `whole` any string.
    """

    def __init__(self, word: Callable[[str], list[int]], whole: Callable[[str], list[int]]):
        def after_space(piece: str) -> bytes:
            return self.one(" " + piece)

        self.word, self.whole = word, whole
        self.spaced, self.bare = PieceCache(after_space), PieceCache(self.one)

    def one(self, piece: str) -> bytes:
        m = WORD_AND_MARKS.fullmatch(piece, 1 if piece[:1] == " " else 0)
        if not m:
            return u32(self.whole(piece))
        return u32(self.word(byte_chars(piece[: m.end(1)]))) + (self.bare[m[2]] if m[2] and len(m[2]) < len(piece) else b"")

    def ids(self, text: str) -> bytes:
        if DOUBLE_SPACE.search(text):
            first, *rest = BEFORE_WORD.split(text)
            return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += [self.bare["\n"], self.bare[first], *map(self.spaced.__getitem__, rest)]
        return b"".join(out[1:])


class BareEncoder:
    """A tokenizer that lower-cases and drops white space."""

    def __init__(self, word: Callable[[str], list[int]], whole: Callable[[str], list[int]]):
        self.word, self.whole, self.bare = word, whole, PieceCache(self.one)

    def one(self, piece: str) -> bytes:
        m = WORD_AND_MARKS.fullmatch(piece)
        if not m:
            return u32(self.whole(piece))
        return u32(self.word(byte_chars(m[1].lower()))) + (self.bare[m[2]] if m[2] else b"")

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))


def library_encoder(path: str) -> SpacedEncoder | BareEncoder:
    """This worker's encoder over the tokenizers library with the file at `path`."""
    encoders = common.worker_cache("encoders")
    if path not in encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model = tokenizer.model
        kind = BareEncoder if tokenizer.normalizer else SpacedEncoder
        encoders[path] = kind(lambda word: [t.id for t in model.tokenize(word)], lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
    return encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
