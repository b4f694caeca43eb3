"""Vector best-fit packing of token sequences.

A sequence has several capacities: tokens, documents and attention cost (the
sum of squared lengths, when documents do not attend to each other). Pieces are
placed longest first. Among the open sequences in which a piece fits under every
capacity, the one with the smallest weighted norm of what is left after placing
it is taken (``norm``), or the one whose residual has the largest weighted dot
product with the piece (``dot``).

Pieces are dealt at random into groups of a bounded number, each packed in one
task. Sequences that a group leaves with much room are opened again and their
pieces dealt into a second round, so that grouping costs next to nothing.

Defined results: a NULL or empty text is one piece that holds the end token
only; rows that repeat an id are packed each; NULL ids are kept and come last
among pieces of equal length, and every other id stays exactly as it is; an empty table gives no rows;
ties go to the earlier sequence, and pieces of equal length follow the id;
further input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows, written
from areaindex.llm.tokens import word_table

GROUP = 4096
#: Characters and rows of the texts that are encoded at once.
TEXT_CHARS, TEXT_ROWS = 1_000_000, 10_000
#: Sequences filled below this share are packed again in the second round.
REOPEN = 0.97


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence and the weight of each in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    choice: str = "norm"


def best_fit(lengths: Sequence[int], limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are to be at most ``limits.tokens``."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > limits.tokens or lengths.max() ** 2 > limits.attention or limits.documents < 1):
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    capacity = np.array([limits.tokens, limits.documents, limits.attention], np.float64)
    weights = np.array(limits.weights)[:, None]
    left = np.empty((3, len(lengths)))  # residuals of the open sequences, of which there are ``n``
    number = np.empty(len(lengths), np.int64)
    n = made = 0
    least = int(lengths.min()) if len(lengths) else 0
    closed = 0
    for i in order.tolist():
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])[:, None]
        after = left[:, :n] - need
        fits = np.flatnonzero((after >= 0).all(axis=0)) if n else ()
        if len(fits):
            if limits.choice == "dot":
                score = -(weights * (left[:, fits] / capacity[:, None]) * (need / capacity[:, None])).sum(axis=0)
            else:
                score = (weights * (after[:, fits] / capacity[:, None]) ** 2).sum(axis=0)
            at = fits[np.argmin(score)]
        else:
            at, n, made = n, n + 1, made + 1
            left[:, at], number[at] = capacity, made - 1
        sequence[i], offset[i] = number[at], limits.tokens - left[0, at]
        left[:, at] -= need[:, 0]
        closed += left[0, at] < least
        if closed > 256:  # drop sequences in which nothing fits any more
            stay = np.flatnonzero((left[0, :n] >= least) & (left[1, :n] >= 1))
            left[:, : len(stay)], number[: len(stay)] = left[:, stay], number[stay]
            n, closed = len(stay), 0
    return sequence, offset


def _batches(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(key, text) rows in runs of bounded text; a longer text ends its run."""
    held: list[tuple] = []
    chars = 0
    for item in items:
        held.append(item)
        chars += len(item[1] or "")
        if chars >= TEXT_CHARS or len(held) >= TEXT_ROWS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def token_pieces(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048, end_id: int = 0
) -> DataFrame:
    """(key, piece, start, length, ids): token ids of each text with the end id, cut only where longer than ``limit``."""
    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        encoder = word_table(vocabulary)
        for held in _batches(items):
            for (k, _), ids in zip(held, encoder.encode([t for _, t in held])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    yield k, piece, at // 4, len(part) // 4, part

    return map_rows(
        docs.select(col(key), col(text).cast("string")),
        f"`{key}` {kind}, piece int, start long, length long, ids binary", rows, per_batch=500,
    )


def _packed(pieces: DataFrame, limits: Limits, count: int, band: int, group_size: int) -> DataFrame:
    """Place the pieces group by group; sequence ids carry ``band`` and the group."""
    groups = max(1, math.ceil(count / group_size))
    dealt = pieces.withColumn(
        "group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    )
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "filled")]
    names = [f.name for f in fields]
    key, schema = names[0], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def place(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("length", "descending"), (key, "ascending"), ("piece", "ascending")])
        group = group.take(order)
        lengths = group["length"].to_numpy()
        sequence, offset = best_fit(lengths, limits)
        base = (2 * group["group"][0].as_py() + band) << 32
        filled = np.bincount(sequence, lengths)[sequence].astype(np.int64)
        out = group.select(names)
        for name, values in (("sequence_id", base + sequence), ("offset", offset), ("filled", filled)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return dealt.select(*[col(n) for n in names], "group").groupBy("group").applyInArrow(
        place, f"{schema}, sequence_id long, offset long, filled long"
    )


def pack(pieces: DataFrame, limits: Limits = Limits(), group_size: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (key first, with ``piece`` and ``length``).

    The pieces should be a written table or cheap to read: they are counted and
    then read again.
    """
    first = written(_packed(pieces, limits, pieces.count(), 0, group_size), "packed")
    loose = first.where(F.col("filled") < REOPEN * limits.tokens)
    again = _packed(loose, limits, loose.count(), 1, group_size)
    return first.where(F.col("filled") >= REOPEN * limits.tokens).unionByName(again).drop("filled")


def sequences(placed: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids): the packed token ids, pieces in order of their offset."""
    joined = placed.select(key, "piece", "sequence_id", "offset").join(ids.select(key, "piece", "ids"), [key, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"])).alias("ids")
    )
