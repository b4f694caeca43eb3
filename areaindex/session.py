"""Session-level helpers: reliable checkpoints and null-safe joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    A session that names none uses a folder of its warehouse, which executors
    share as well; a machine-local folder would be lost with the machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    context.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Let joins use a partitioning by some of their keys, as that of tables in buckets.

    Without it a join on (area, year) shuffles tables that are in buckets by
    area. For keys of which no single value holds many rows; the jobs must run
    inside the block.
    """
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    held = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, held)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 2 * 1024 * 1024


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the Arrow batches of the jobs inside the block by bytes.

    By default a batch is 64 MB, which the executor and its worker both hold in
    several forms, and a worker keeps much of it for later tasks. A bound that
    the session sets itself stays.
    """
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf in spark.conf.getAll:
        yield
        return
    spark.conf.set(conf, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(conf)


SMALL_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """Give a small table as many partitions as a shuffle has.

    Work that costs much per row and few bytes, such as geometry, would stay in
    the few tasks that a small file or a coalesced shuffle yields. Large tables
    arrive in many partitions and are left as they are.
    """
    if rows > SMALL_ROWS:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


BROADCAST_BYTES = 64 * 1024 * 1024


def join_measured(large: DataFrame, small: DataFrame, on: Sequence[str], small_bytes: int) -> DataFrame:
    """Join with a side whose size was measured: broadcast up to a bound, sort-merge beyond.

    For exploded frames, which the planner takes to be as small as before the
    explode and would broadcast at any size.
    """
    if small_bytes <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), list(on))
    return large.join(small.hint("merge"), list(on))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def one_row(df: DataFrame) -> F.Column:
    """All columns of a one-row frame as one struct, usable as a scalar subquery."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()
