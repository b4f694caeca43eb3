"""What several operators share: scratch tables, column access, worker-wide caches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from areaindex.session import BROADCAST_BYTES, ensure_checkpoint_dir, small_batches


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: later stages read files that outlive executors. Python
    workers get small batches meanwhile.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """The rows of ``docs`` whose ``on`` is not in ``gone``, a written table of one column.

    Rows stay where they are while the measured size of ``gone`` allows a
    broadcast; beyond it they are shuffled once.
    """
    n, text = gone.agg(F.count(F.lit(1)), F.sum(F.octet_length(col(on).cast("string")))).first()
    small = 32 * n + (text or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone.hint("merge"), on, "left_anti")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name}`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """An object kept by the Python worker from task to task."""
    store = sys.__dict__.setdefault("_areaindex_llm", {})
    if name not in store:
        store[name] = make()
    return store[name]


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[tuple]], per_batch: int = 2000, at_once: int | None = None
) -> DataFrame:
    """Run a generator over the rows of each partition, Arrow batch by Arrow batch.

    ``rows`` gets the rows as tuples of Python values and yields tuples in the
    order of ``schema``; at most ``per_batch`` of them are held before they go
    back to the JVM. ``at_once``: how many rows of a batch are turned into
    Python values at a time, for rows that are large; all by default.
    """
    arrow = to_arrow_schema(T.DataType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def incoming():
            for batch in batches:
                step = at_once or max(batch.num_rows, 1)
                for at in range(0, batch.num_rows, step):
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, step).columns])

        held: list[tuple] = []
        for row in rows(incoming()):
            held.append(row)
            if len(held) >= per_batch:
                yield to_batch(held, arrow)
                held = []
        if held:
            yield to_batch(held, arrow)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), arrow)], schema=arrow
    )
