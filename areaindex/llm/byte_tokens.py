"""Byte-level token ids of whole texts, with a cache of the pieces that texts are split into.

Merges never cross the borders of these pieces and most pieces of a corpus
repeat, so each is encoded once, by the tokenizer's own model without its split,
and looked up from then on. Texts with a character outside the range where splitting is plain, or with what
may be a special token, go through the tokenizer whole; the ids are the same
either way.
"""

from __future__ import annotations

import re

import numpy as np

from areaindex.llm.common import per_process

#: Pieces kept before the cache starts anew, and the longest that is kept; both bound a worker's memory.
CACHE_PIECES = 1_000_000
LONGEST_PIECE = 64
# Characters for which the fast path holds, and the split of the
# tokenizer on them: contractions, letters, digits, other signs, white space.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-~¡-ÿ]")
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+"
    "| ?[^\\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|\\s+(?!\\S)|\\s+"
)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary, by Latin-1 code point."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class BytePieces:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens being added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = byte_characters()
        self.known: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.characters)
        return np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _UNUSUAL.search(text) or "<|" in text:
            return self._ids(text)
        pieces = _PIECE.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            for at, ids in enumerate(found):
                if ids is None:
                    piece = pieces[at]
                    ids = self.known.get(piece) or self._learn(piece)
                    if len(piece) <= LONGEST_PIECE:
                        self.known[piece] = ids
                    found[at] = ids
        return b"".join(found)


def byte_pieces(path: str) -> BytePieces:
    """The worker's encoder for a vocabulary file."""
    return per_process(f"byte pieces:{path}", lambda: BytePieces(path))
