"""Tokenising by white-space-free pieces with a bounded cache; the same ids as the tokenizer gives for the whole text."""

from __future__ import annotations

import functools
import os
from array import array

from .common import worker_cache


def load(path: str):
    """The tokenizer of a vocabulary file, one for each Python worker and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _load(path)


@functools.lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Young(dict):
    """A dict that asks its owner for what it lacks; map(young.__getitem__, ...) stays in C for what it has."""

    def __init__(self, owner: PieceCache):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        return self.owner.miss(piece)


class PieceCache:
    """Ids of pieces as little-endian unsigned 32-bit numbers. At most two generations of ``limit`` pieces are held:
    when the young one is full it becomes the old one, and pieces still in use move back to the young."""

    def __init__(self, tokenizer, limit: int = 300_000):
        self.tokenizer, self.limit = tokenizer, limit
        self.young, self.old = _Young(self), {}

    def ids(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def miss(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.split(piece)
        return self.keep(piece, got)

    def keep(self, piece: str, got: bytes) -> bytes:
        """Remembers the ids of a piece of 64 characters at most."""
        if len(piece) <= 64:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, _Young(self)
            self.young[piece] = got
        return got

    def split(self, piece: str) -> bytes:
        return self.ids(piece)

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.young.__getitem__, pieces))


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + i for i, b in enumerate(hidden)}


def byte_level(text: str) -> str:
    """The text as byte-level vocabularies spell it."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_byte_letters())


class WordEnds(PieceCache):
    """For the lower-case vocabulary whose words never span white space: texts are cut at ASCII spaces and line breaks.

    Letters followed by stops encode as the letters, then the stops. Plain Latin letters encode as in lower case, and
    are one word, so that the model can take them without the steps before it.
    """

    def ids_of_word(self, low: str) -> bytes:
        got = dict.get(self.young, low) or dict.get(self.old, low)
        if got is None:
            got = self.keep(low, array("I", [t.id for t in self.tokenizer.model.tokenize(low if low.isascii() else byte_level(low))]).tobytes())
        return got

    def split(self, piece: str) -> bytes:
        if not piece:
            return b""
        core = piece.rstrip(".,")
        if core.isalpha() and (core.isascii() or (max(core) < "ɐ" and "İ" not in core)):
            got = self.ids_of_word(core.lower())
            return got if len(core) == len(piece) else got + self.young[piece[len(core) :]]
        return self.ids(piece)

    def text(self, text: str | None) -> bytes:
        return self.encode(text.replace("\n", " ").split(" ")) if text else b""


def word_ends(path: str) -> WordEnds:
    """One cache for each Python worker and vocabulary: tasks after the first find it warm."""
    return worker_cache(f"word_ends {path}", lambda: WordEnds(load(path)))


PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def pre_tokens():
    """The byte-level vocabulary's pre-token pattern, compiled."""
    import regex

    return regex.compile(PRE_TOKEN)

