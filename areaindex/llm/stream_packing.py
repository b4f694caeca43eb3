"""Sum-of-squares online packing of token sequences.

A window has a fixed size. A document's full windows are sequences of their own;
what remains of it is placed at once, without a look ahead: among the levels to
which open windows are filled, and the empty window, it goes to the one for
which the sum over levels of the squared number of windows at that level comes
out smallest. Windows at many different levels can take any length, so few stay
open. The state is a level array: how many windows stand at each level, and
which.

Every partition of the documents is one stream. Its open windows are bounded;
when they are too many, and at its end, they are closed: windows whose length
needs no padding stay as they are, the others are topped up to the full size by
cutting what the emptiest of them hold, and the last one is cut into lengths
that need no padding. So no sequence is padded, and cuts are few: one per window
closed.

One pass, no shuffle: memory is a task's open windows and one text. A task that
is run again packs the same rows anew and replaces its whole stream; sequence
ids carry the number of the partition.

Defined results: a NULL or empty text is one piece that holds the end token
only; rows that repeat an id are packed each; NULL ids are kept; a very long
text is cut into full windows as it is read; equal sums are settled for the
fullest level; an empty table gives no rows; further input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from areaindex.llm.byte_tokens import byte_pieces
from areaindex.llm.common import col, map_rows

SIZE = 1024
#: Open windows of a stream before they are closed; bounds a task's memory.
OPEN = 4096


@dataclass
class Piece:
    """``length`` tokens of a document from ``start`` on; ``document`` is (key, doc_tokens)."""

    document: tuple
    start: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.document, self.start, self.ids[: 4 * tokens]),
            Piece(self.document, self.start + tokens, self.ids[4 * tokens :]),
        )


Window = list[Piece]


class LevelArray:
    """Open windows by the level they are filled to."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # level 0 is the empty window, the full one is closed: both count 0
        self.windows: dict[int, list[Window]] = {}
        self.n_open = 0

    def level_for(self, length: int) -> int:
        """The level to place ``length`` on: smallest sum of squared counts, then the fullest."""
        last = self.size - length
        here, there = self.counts[: last + 1], self.counts[length : length + last + 1]
        # squares change by 1 - 2n at the level left and by 1 + 2n at the level reached
        change = 2 * there - 2 * here + 2
        change[0] -= 1
        change[last] -= 1  # a window that gets full leaves the array
        usable = here > 0
        usable[0] = True
        levels = np.flatnonzero(usable)
        of_usable = change[levels]
        return int(levels[len(levels) - 1 - np.argmin(of_usable[::-1])])

    def place(self, piece: Piece) -> Window | None:
        """Put a piece shorter than a window on its level; the window if that fills it."""
        level = self.level_for(piece.length)
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
        else:
            window = []
            self.n_open += 1
        window.append(piece)
        level += piece.length
        if level == self.size:
            self.n_open -= 1
            return window
        self.windows.setdefault(level, []).append(window)
        self.counts[level] += 1
        return None

    def close(self) -> Iterator[Window]:
        """All open windows, recut so that none needs padding; the array is empty afterwards."""
        held = [(level, w) for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        self.__init__(self.size)
        yield from (w for level, w in held if level & (level - 1) == 0)
        uneven = [(level, w) for level, w in held if level & (level - 1)]
        first, last = 0, len(uneven) - 1
        while first < last:  # the fullest is topped up from the emptiest
            level, window = uneven[first]
            left, source = uneven[last]
            gap = self.size - level
            if left <= gap:
                window += source
                uneven[first] = (level + left, window)
                last -= 1
                if left < gap:
                    continue
            else:
                moved, rest = split(source, left - gap)[::-1]
                window += moved
                uneven[last] = (left - gap, rest)
            yield window
            first += 1
        if first == last:
            level, rest = uneven[first]
            for bit in range(level.bit_length() - 1, -1, -1):
                if level >> bit & 1:
                    part, rest = split(rest, 1 << bit)
                    yield part


def split(window: Window, tokens: int) -> tuple[Window, Window]:
    """The first ``tokens`` of a window and the rest."""
    head: Window = []
    for at, piece in enumerate(window):
        if piece.length > tokens:
            if not tokens:
                return head, window[at:]
            a, b = piece.cut(tokens)
            return [*head, a], [b, *window[at + 1 :]]
        head.append(piece)
        tokens -= piece.length
    return head, []


def stream(documents: Iterator[tuple], size: int = SIZE, open_windows: int = OPEN) -> Iterator[Window]:
    """Windows of the documents (key, ids with the end token), in the order in which they are closed."""
    levels = LevelArray(size)
    for key, ids in documents:
        n = len(ids) // 4
        document = (key, n)
        full = n - n % size
        for at in range(0, full, size):
            yield [Piece(document, at, ids[4 * at : 4 * (at + size)])]
        if full < n:
            done = levels.place(Piece(document, full, ids[4 * full :]))
            if done:
                yield done
            if levels.n_open >= open_windows:
                yield from levels.close()
    yield from levels.close()


def pack_stream(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = SIZE,
    open_windows: int = OPEN, end_id: int = 0,
) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, ids): one row per piece of a document."""
    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        encoder = byte_pieces(vocabulary)
        base = TaskContext.get().partitionId() << 40
        coded = ((k, encoder.encode(t) + end) for k, t in items)
        for number, window in enumerate(stream(coded, size, open_windows)):
            offset = 0
            for piece in window:
                k, total = piece.document
                yield k, piece.start, piece.length, total, base + number, offset, piece.ids
                offset += piece.length

    return map_rows(
        docs.select(col(key), col(text).cast("string")),
        f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
        rows, per_batch=500,
    )
