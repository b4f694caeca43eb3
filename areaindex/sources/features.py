"""Feature collections read by byte ranges, whatever their line breaks.

A JSON document cannot be cut at any byte: whether a brace counts depends on
all quotes before it. So the files are read twice. First every range tells how
many quotes it holds and how far it moves the nesting depth, for the two cases
that it starts inside or outside a string. Sums over the ranges of a file then
give each its starting state, and in the second pass a range emits the features
that begin in it, reading on until the last of them is closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaindex.session import checkpointed

RANGE_BYTES = 8 * 1024 * 1024
#: Bytes looked at together; the work on one takes some fifty times as much memory.
BLOCK_BYTES = 1024 * 1024
#: Depth at which a feature opens: inside the collection and its array of features.
FEATURE_DEPTH = 2

_QUOTE, _ESCAPE = ord('"'), ord("\\")


def _marks(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """(quotes that open or close a string, step of the depth) at every byte; ``escaped`` is the state of the first."""
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _ESCAPE, place, -1))
    before = np.concatenate([[-1], plain[:-1]])
    run = place - 1 - before + (escaped & (before < 0))
    quotes = (data == _QUOTE) & (run % 2 == 0)
    steps = ((data == ord("{")) | (data == ord("["))).astype(np.int8) - ((data == ord("}")) | (data == ord("]")))
    return quotes, steps


def _escaped_at(file, at: int) -> bool:
    """Whether the byte at a place follows an odd run of backslashes."""
    run = 0
    while at - run > 0 and file.read_at(1, at - run - 1) == b"\\":
        run += 1
    return run % 2 == 1


def _blocks(file, start: int, end: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(place, bytes, quotes, steps) of one block after another."""
    for at in range(start, end, BLOCK_BYTES):
        data = file.read_at(min(BLOCK_BYTES, end - at), at)
        yield at, data, *_marks(np.frombuffer(data, np.uint8), _escaped_at(file, at))


def _summaries(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in incoming:
        rows = []
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            count, moved = 0, [0, 0]
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as file:
                for _, _, quotes, steps in _blocks(file, start, end):
                    odd = (np.cumsum(quotes) + count) % 2 == 1
                    moved = [moved[0] + int(steps[~odd].sum()), moved[1] + int(steps[odd].sum())]
                    count += int(quotes.sum())
            rows.append((path, start, end, count, *moved))
        yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, r)) for r in rows], _SUMMARY)


_SUMMARY = pa.schema([
    ("path", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "quotes", "outside_step", "inside_step")]
])


def _features_of(file, start: int, end: int, inside: bool, depth: int, size: int) -> Iterator[str]:
    """Objects that open at the depth of features within a range, read on beyond it to the end of the last."""
    pending: list[bytes] = []  # the parts of an object that is open
    for at, data, quotes, steps in chain(_blocks(file, start, end), _blocks(file, end, size)):
        if at >= end and not pending:
            return
        within = (np.cumsum(quotes) + inside) % 2 == 1
        moves = np.where(within, 0, steps)
        depths = depth + np.cumsum(moves)
        inside, depth = bool(within[-1]), int(depths[-1])
        found = np.frombuffer(data, np.uint8)
        opens = np.flatnonzero((moves > 0) & (depths == FEATURE_DEPTH + 1) & (found == ord("{"))).tolist()
        closes = np.flatnonzero((moves < 0) & (depths == FEATURE_DEPTH) & (found == ord("}"))).tolist()
        if closes and (not opens or closes[0] < opens[0]):
            close = closes.pop(0) + 1
            if pending:  # else it began in an earlier range
                yield b"".join([*pending, data[:close]]).decode("utf-8", "replace")
                pending = []
        if pending:
            pending.append(data)
        if at >= end:
            continue
        for place, close in zip(opens, closes):
            yield data[place:close + 1].decode("utf-8", "replace")
        if len(opens) > len(closes):
            pending = [data[opens[-1]:]]


def read_feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(feature): the JSON text of every feature of the collections at ``path``, read by many tasks.

    Objects as deep in other members of a collection come too; readers look at
    their type. An empty file has no features; a file that ends within a
    feature yields it not.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length").where("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # stored: a few numbers per range, read by the sums and by the second pass
    known = checkpointed(
        ranges.repartition(tasks, "path", "start")
        .mapInArrow(_summaries, "path string, start long, end long, quotes long, outside_step long, inside_step long")
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stated = known.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    step = F.when(F.col("inside"), F.col("inside_step")).otherwise(F.col("outside_step"))
    stated = stated.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    sized = stated.withColumn("size", F.max("end").over(Window.partitionBy("path")))

    def texts(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in incoming:
            for where, *state in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = fs.FileSystem.from_uri(where)
                with store.open_input_file(place) as file:
                    held, held_bytes = [], 0
                    for text in _features_of(file, *state):
                        held.append(text)
                        held_bytes += len(text)
                        if held_bytes >= RANGE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["feature"])
                            held, held_bytes = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["feature"])

    spread = sized.select("path", "start", "end", "inside", "depth", "size").repartition(tasks, "path", "start")
    return spread.mapInArrow(texts, "feature string")
