"""Token ids of whole texts, with a cache of word pieces.

Pieces never cross white space and most words of a corpus repeat, so encoding
each word once, by the tokenizer's own model without its split, and looking it up
is several times faster than running the merges on every text. The cache has two
generations: when the newer one is full it becomes the older, and what was in
the older and not met since is dropped; so words in use stay and those met once
go. Texts with a
character outside the range where splitting is plain go through the tokenizer
as they are; the ids are the same either way.

``WordTable`` does the same for many texts at once: the words of all of them are
reduced to distinct ones by Arrow, and only those are looked up, in Arrow arrays
that take a fraction of the memory of Python's words.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from areaindex.llm.byte_tokens import byte_characters
from areaindex.llm.common import per_process

#: Words kept in both generations, and the longest that is kept; both bound a worker's memory.
CACHE_WORDS = 300_000
LONGEST_WORD = 64
#: Words that a ``WordTable`` keeps, at about 35 bytes each.
TABLE_WORDS = 400_000
# Characters for which the fast path holds, and the pieces that
# the tokenizer's own split gives on them, in lower case.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-~¡-ÿ]")
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]"
    "|[^\\s0-9a-zª²³µ¹º¼-¾ß-öø-ÿ]+"
)


class WordPieces:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = byte_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, piece: str) -> list[int]:
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(written)]

    def _learn(self, word: str) -> bytes:
        ids = []
        for piece in _PIECE.findall(word):
            ids += self.ids(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _recall(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the newer generation lacks; from then on it has them, as far as there is room."""
        older, half = self.older, CACHE_WORDS // 2
        fresh = {w: older.get(w) or self._learn(w) for w in words}
        if len(self.known) + len(fresh) > half:
            self.older, self.known = self.known, {}
        for w, ids in fresh.items():
            if len(w) <= LONGEST_WORD and len(self.known) < half:
                self.known[w] = ids
        return fresh

    @staticmethod
    def plain(text: str) -> bool:
        """Whether the text may be split into words."""
        return not (_UNUSUAL.search(text) or "<|" in text)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return self.encode_whole(text)
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            fresh = self._recall({w for w, ids in zip(words, found) if ids is None})
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)


def word_pieces(path: str) -> WordPieces:
    """The worker's encoder for a vocabulary file."""
    return per_process(f"pieces:{path}", lambda: WordPieces(path))


class WordTable:
    """Encodes many texts at once, with the ids of words in Arrow arrays from call to call.

    When there are more than ``TABLE_WORDS``, the half that was met last stays.
    """

    def __init__(self, path: str):
        self.pieces = WordPieces(path)
        self.words = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.uint32()))
        self.met = np.empty(0, np.int64)  # the call in which each word was last met
        self.calls = 0

    def _learn(self, words: list[str]) -> pa.ListArray:
        known: dict[str, list[int]] = {}
        ids, ends = array("I"), [0]
        for word in words:
            for piece in (word,) if word.isalpha() else _PIECE.findall(word):
                if (found := known.get(piece)) is None:
                    found = known[piece] = self.pieces.ids(piece)
                ids.extend(found)
            ends.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.uint32)))

    def _ids_of(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct words; those that the table lacks are learnt."""
        self.calls += 1
        at = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()
        hit = np.flatnonzero(at >= 0)
        self.met[hit] = self.calls
        place = np.full(len(words), -1)
        place[at[hit]] = hit
        lacking = np.flatnonzero(place < 0)
        place[lacking] = len(self.words) + np.arange(len(lacking))
        fresh = words.take(pa.array(lacking))
        learnt = self._learn(fresh.to_pylist())
        found = pa.concat_arrays([self.ids, learnt]).take(pa.array(place))
        short = pc.less_equal(pc.utf8_length(fresh), LONGEST_WORD)
        self._keep(fresh.filter(short), learnt.filter(short))
        return found

    def _keep(self, words: pa.StringArray, ids: pa.ListArray) -> None:
        words, ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        met = np.r_[self.met, np.full(len(words) - len(self.met), self.calls)]
        if len(words) > TABLE_WORDS:
            stay = np.sort(np.argsort(-met, kind="stable")[: TABLE_WORDS // 2])
            words, ids, met = words.take(pa.array(stay)), ids.take(pa.array(stay)), met[stay]
        self.words, self.ids, self.met = words, ids, met

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        found = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and self.pieces.plain(text):
                plain.append(i)
            elif text:
                found[i] = self.pieces.encode_whole(text)
        if plain:
            # White space at the start of a text yields an empty word, which has no ids.
            words = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.string()))
            coded = words.values.dictionary_encode()
            ids = self._ids_of(coded.dictionary).take(coded.indices)
            whole = ids.values.to_numpy().astype("<u4", copy=False)
            ends = ids.offsets.to_numpy()[words.offsets.to_numpy()].tolist()
            for i, start, end in zip(plain, ends, ends[1:]):
                found[i] = whole[start:end].tobytes()
            del words, coded, ids, whole
            pa.default_memory_pool().release_unused()  # else a worker keeps what a call took at most
        return found


def word_table(path: str) -> WordTable:
    """The worker's table for a vocabulary file."""
    return per_process(f"words:{path}", lambda: WordTable(path))
