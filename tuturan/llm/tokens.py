"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

Texts of natural language repeat their words, and the library's byte-level splitting never joins
text across a single space or line break between two other characters. So a text is cut there, each
distinct piece is encoded by the library once and remembered, and the ids of the text are the joined
ids of its pieces. A text with other spaces, with runs of white space in which the library joins
more than one character, or with the name of an added token goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import cache

import numpy as np

PIECES_KEPT = 400_000  # remembered pieces in a worker, about 150 bytes each

# Letters whose class is the same in every Unicode version, then marks that are neither letter,
# number, space nor apostrophe: two pieces for the library, whatever their length.
_PLAIN = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


class _OddSpace(Exception):
    """The text holds white space that the pieces do not account for."""


def _byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    named = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [named[b] for b in range(256)]


class _Pieces(dict):
    """Ids of pieces by the text behind their blank, or from their line break on."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if not word:
            raise _OddSpace
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = self.encode(word if word[0] == "\n" else " " + word)
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, those of the library's own ``encode``.

    The name of an added token in a text, such as ``<|endoftext|>``, gives that token's id.
    """

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        characters = _byte_characters()
        self.bytes_as = dict(enumerate(characters))
        self.blank, self.line_break = characters[ord(" ")], characters[ord("\n")]
        self.parts: dict[str, bytes] = {}
        self.kept = kept
        self.pieces = _Pieces(self._piece, kept)

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """A piece that the library's splitter leaves in one."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.kept:
                self.parts.clear()
            if part.isascii():  # of letters and marks only a blank is written otherwise
                written = part.replace(" ", self.blank).replace("\n", self.line_break)
            else:
                written = part.encode().decode("latin-1").translate(self.bytes_as)
            ids = [t.id for t in self.tokenize(written)]
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _piece(self, piece: str) -> bytes:
        m = _PLAIN.fullmatch(piece)
        if m is None:
            if any(c.isspace() for c in piece[1:]):
                raise _OddSpace
            return self._whole(piece)
        line_break, word, marks = m.groups()
        if line_break:
            if word[0] == " ":
                return self._whole(piece)
            return self._part(line_break) + self._part(word) + (self._part(marks) if marks else b"")
        return self._part(word) + self._part(marks) if marks else self._part(word)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        # Of a run of white space the library takes all but the last character in one, or all of it
        # at the end. Runs of two pieces are cut alike; other longer ones hold an empty piece.
        if "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"):
            return self._whole(text)
        if any(name in text for name in self.added):
            return self._whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            if not first or any(c.isspace() for c in first):
                raise _OddSpace
            return self._piece(first) + b"".join(map(self.pieces.__getitem__, words))
        except _OddSpace:
            return self._whole(text)


@cache
def encoder(path: str) -> Encoder:
    """One encoder in each worker, with what it remembers."""
    return Encoder(path)
