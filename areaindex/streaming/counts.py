"""Monthly incident counts as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monthly_counts_stream(
    stream: DataFrame, area: str, ts: str, type_col: str, watermark: str = "31 days",
    unit: str = "month",
) -> DataFrame:
    """Counts per area, month and type of an incident feed that arrives in pieces.

    The watermark bounds the state: a month is closed, and its row emitted,
    once no incident that late is expected any more. Daily feeds may use
    another calendar ``unit``.
    """
    start = F.date_trunc(unit, F.col(ts)).cast("timestamp")
    return (
        stream.withColumn("period", start).withWatermark("period", watermark)
        .groupBy(area, "period", type_col).agg(F.count(F.lit(1)).alias("n"))
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write to parquet, taking what is there and then stopping; a restart goes on from ``checkpoint``."""
    return (
        counts.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_open_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every change of a count, so that open periods show too; read with ``read_open_counts``.

    A batch that is repeated after a failure overwrites its own folder.
    """
    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        counts.writeStream.foreachBatch(store).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_open_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest count of each key that ``write_open_counts`` has stored."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
