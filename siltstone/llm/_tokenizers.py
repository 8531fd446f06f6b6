"""Token ids by the tokenizers library, with its model called once per distinct piece.

Both vocabularies split a text at white space before anything else, so a text's
tokens are those of its pieces in order. Pieces are remembered per process in
dictionaries of bounded size. Whatever could make a piece depend on its
surroundings, or on tables that Python and the library may hold in different
versions, goes to the library whole.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import regex

MOST_PIECES = 600_000
#: Unicode white space, as the library's expressions see it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters on whose class and case all Unicode versions agree: up to Latin Extended-B.
_PLAIN = regex.compile("[\\x00-\\x1b\\x20-\\u024f]*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of a tokenizer's file: another file, another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> dict[int, str]:
    """The usual one-character names of bytes: themselves where printable, else the next free from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_STOPS = (".", ",")


def _letters_only(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) <= "\u012f")


class _Base:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {ord(bytes([b]).decode("latin-1")): x for b, x in _byte_letters().items()}
        self.pieces: dict = {}
        self.words: dict = {}

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def simple(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def piece_ids(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(piece)]


class ByteLevelCounter(_Base):
    """Counts tokens of a byte-level vocabulary, in which a space belongs to the word that follows it."""

    _SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
    _SOLID = regex.compile(rf"[^{_WS}](?:.*[^{_WS}])?", regex.DOTALL)

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            n = self.pieces[piece] = len(self.piece_ids(piece))
        return n

    def _count(self, text: str) -> int:
        return sum(map(self._piece, self._SPLIT.findall(text)))

    def _word(self, word: str) -> int | None:
        """Tokens of a space and the word; None if the word is not bounded by other than white space."""
        if len(self.words) >= MOST_PIECES:
            self.words.clear()
        n = None
        if _letters_only(word):
            n = self._piece(f" {word}")
        elif word[-1:] in _STOPS and _letters_only(word[:-1]):
            n = self._piece(f" {word[:-1]}") + self._piece(word[-1])
        elif self._SOLID.fullmatch(word):
            n = self._count(f" {word}") if self.simple(word) else len(self.whole(f" {word}"))
        self.words[word] = n
        return n

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            return len(self.whole(text))
        first, *rest = text.split(" ")
        if not self._SOLID.fullmatch(first):
            return self._count(text) if self.simple(text) else len(self.whole(text))
        total, words = self._count(first) if self.simple(first) else len(self.whole(first)), self.words
        for w in rest:
            n = words.get(w, -1)
            if n == -1:
                n = self._word(w)
            if n is None:
                return self._count(text) if self.simple(text) else len(self.whole(text))
            total += n
        return total


class WordEncoder(_Base):
    """Ids of a vocabulary of lower-case words with word ends; white space is dropped."""

    _SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
    _ODD = regex.compile("[\\x1c-\\x1f]")

    def _word(self, word: str) -> bytes:
        if len(self.words) >= MOST_PIECES:
            self.words.clear()
        if _letters_only(word):
            found = self._piece(word.lower())
        elif word[-1:] in _STOPS and _letters_only(word[:-1]):
            found = self._piece(word[:-1].lower()) + self._piece(word[-1])
        elif self.simple(word):
            found = b"".join(map(self._piece, self._SPLIT.findall(word.lower())))
        else:
            found = array("I", self.whole(word)).tobytes()
        self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        own = self.pieces.get(piece)
        if own is None:
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            own = self.pieces[piece] = array("I", self.piece_ids(piece)).tobytes()
        return own

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, one after another."""
        if self._ODD.search(text):
            return array("I", self.whole(text)).tobytes()
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in text.split()])


_LOADED: dict = {}


def load(kind: type, path: str):
    """One instance per process."""
    if (kind.__name__, path) not in _LOADED:
        _LOADED[kind.__name__, path] = kind(path)
    return _LOADED[kind.__name__, path]
