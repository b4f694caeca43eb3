"""Exact positions, ranks and quantiles that do not depend on one task holding a group.

Quantiles are selected by refinement: sketches bracket the wanted positions and
a second pass counts what lies between the brackets, so hardly any value is
shuffled; the result is exact.

Ranks work on the number of rows per distinct value, so a value that a third of
all rows share is one row. These counts are stored once. The values are cut into
slices at approximate quantiles, which a scalar subquery
finds; each slice of a group is numbered on its own and shifted by the sizes of
the slices before it. The slice is a function of the value, so it is the same
wherever it is computed.

Positions need an order over several columns. Rows are range partitioned on
(group, order), numbered slice by slice and shifted the same way. The sliced
rows are checkpointed, because the slice of a row must not change when a lost
executor makes Spark read it again.

There is one plan at every size, and positions are always ``long``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaindex.session import BROADCAST_BYTES, checkpointed, join_null_safe

#: Share of a group's rows that the first sketch may be wrong by is one over this.
ACCURACY = 10_000

_SLICE, _COUNT, _BEFORE, _LESS = "__slice", "__n", "__before", "__less"
_EARLIER = (Window.unboundedPreceding, -1)


def _slices(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_offsets(
    sliced: DataFrame, by: Sequence[str], weight: Column, ascending: bool = True
) -> DataFrame:
    """Add the total weight of all earlier slices of the same group."""
    keys = [*by, _SLICE]
    place = F.col(_SLICE).asc() if ascending else F.col(_SLICE).desc()
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(place).rowsBetween(*_EARLIER)
    offsets = (
        sliced.groupBy(*keys).agg(F.sum(weight).alias("__w"))
        .withColumn(_BEFORE, F.coalesce(F.sum("__w").over(window), F.lit(0)))
        .drop("__w")
    )
    return join_null_safe(sliced, offsets, keys)


def with_position(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """1-based row number inside each group, as long; ``order`` must identify a row."""
    ranged = df.repartitionByRange(_slices(df), *[F.col(b) for b in by], *order)
    sliced = _with_offsets(checkpointed(ranged.withColumn(_SLICE, F.spark_partition_id())), by, F.lit(1))
    local = Window.partitionBy(*by, _SLICE).orderBy(*order)
    return (
        sliced.withColumn(out, (F.row_number().over(local) + F.col(_BEFORE)).cast("long"))
        .drop(_SLICE, _BEFORE)
    )


def _value_positions(df: DataFrame, value: str, by: Sequence[str], ascending: bool) -> DataFrame:
    """(by, value, __n rows with the value, __less rows ordered before it)."""
    valued = df.where(F.col(value).isNotNull())
    slices = _slices(df)
    levels = [i / slices for i in range(1, slices)]
    # stored, because all that follows reads the counts and none of it the rows again
    stored = checkpointed(valued.groupBy(*by, value).agg(F.count(F.lit(1)).alias(_COUNT)))
    cuts = stored.agg(F.percentile_approx(F.col(value), levels, 1000)).scalar()
    counts = (
        stored.withColumn("__cuts", cuts)
        .withColumn(_SLICE, F.size(F.filter("__cuts", lambda cut: cut < F.col(value)))).drop("__cuts")
    )
    sliced = _with_offsets(counts, by, F.col(_COUNT), ascending)
    order = F.col(value).asc() if ascending else F.col(value).desc()
    window = Window.partitionBy(*by, _SLICE).orderBy(order).rowsBetween(*_EARLIER)
    return (
        sliced.withColumn(_LESS, F.coalesce(F.sum(_COUNT).over(window), F.lit(0)) + F.col(_BEFORE))
        .drop(_SLICE, _BEFORE)
    )


def average_rank(
    df: DataFrame, value: str, by: Sequence[str] = (), ascending: bool = False, out: str = "rank"
) -> DataFrame:
    """Rank with tied values sharing the mean of their positions; NULL has no rank."""
    positions = (
        _value_positions(df, value, by, ascending)
        .withColumn(out, F.col(_LESS) + (F.col(_COUNT) + 1) / F.lit(2.0))
        .drop(_COUNT, _LESS)
    )
    return join_null_safe(df, positions, [*by, value], "left")


def average_ranks(df: DataFrame, cols: Sequence[str], prefix: str = "rank_") -> DataFrame:
    """``average_rank`` of several numeric columns at once, highest first, as ``prefix`` and the column's name.

    All columns are ranked in one pass; ranking one after the other would
    repeat the plan of the first in that of each later one.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("__name"), F.col(c).cast("double").alias("__value")) for i, c in enumerate(cols)
    ])).alias("__cell")).select("__cell.__name", "__cell.__value")
    rank = F.col(_LESS) + (F.col(_COUNT) + 1) / F.lit(2.0)
    ranks = _value_positions(long, "__value", ["__name"], False).select("__name", "__value", rank.alias("__rank"))
    for i, c in enumerate(cols):
        own = ranks.where(F.col("__name") == i).select(F.col("__value").alias("__key"), F.col("__rank").alias(f"{prefix}{c}"))
        df = df.join(own, F.col(c).cast("double") == F.col("__key"), "left").drop("__key")
    return df


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), stored: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolation quantiles: one row per group, one array per column.

    Groups without a value get NULL. With no ``by`` the result is one row. The
    columns are read twice, so they are stored first, unless ``stored`` says
    that ``df`` is cheap to read.
    """
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = rows if stored else checkpointed(rows)
    long = rows.select(
        *by, F.explode(F.array(*[
            F.struct(F.lit(i).alias("__name"), F.col(c).alias("__value")) for i, c in enumerate(cols)
        ])).alias("__cell"),
    ).select(*by, "__cell.__name", "__cell.__value")
    per_name = _selected(long, [*by, "__name"], probs, accuracy)

    values = []
    for i, p in enumerate(probs):
        share = F.lit(float(p)) * (F.col("__size") - 1)
        part = share - F.floor(share)
        values.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * part)
    held = F.when(F.col("__size") > 0, F.array(*values)).alias("__q")
    return per_name.select(*by, "__name", held).groupBy(*by).agg(*[
        F.max(F.when(F.col("__name") == i, F.col("__q"))).alias(c) for i, c in enumerate(cols)
    ])


def _selected(long: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """(keys, __size, __lo and __hi of each probability): the values at the two positions around a quantile.

    Groups without a value have size 0 and no values.

    A sketch of every group brackets the positions, then one pass over the rows
    compresses each group to runs: within a bracket one run per distinct value,
    outside one per stretch between brackets, with its number of rows and its
    two ends. So what is shuffled are sketches and the few values inside
    brackets. Positions that turn out to lie inside a stretch are looked for
    again, in their groups only, with a sketch ten times as fine.
    """
    found = None
    while True:
        runs = _runs(long, keys, probs, accuracy)
        window = Window.partitionBy(*keys).orderBy("__zone", "__exact").rowsBetween(*_EARLIER)
        placed = runs.withColumn(_LESS, F.coalesce(F.sum(_COUNT).over(window), F.lit(0)))

        def at(index: Column) -> tuple[Column, Column]:
            hit = (F.col(_LESS) <= index) & (index < F.col(_LESS) + F.col(_COUNT))
            value = (
                F.when((index == F.col(_LESS)) | (F.col("__least") == F.col("__most")), F.col("__least"))
                .when(index == F.col(_LESS) + F.col(_COUNT) - 1, F.col("__most"))
            )
            return F.max(F.when(hit, value)), F.bool_or(hit & value.isNull())

        picks, lost = [F.first("__size").alias("__size")], F.lit(False)
        for i, p in enumerate(probs):
            position = F.lit(float(p)) * (F.col("__size") - 1)
            for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
                value, missed = at(index)
                picks.append(value.alias(f"__{side}{i}"))
                lost = lost | missed
        selected = checkpointed(placed.groupBy(*keys).agg(*picks, F.coalesce(lost, F.lit(False)).alias("__lost")))
        lost_groups = selected.where("__lost").select(*keys)
        done = lost_groups.isEmpty()
        settled = (selected if done else selected.where("NOT __lost")).drop("__lost")
        found = settled if found is None else found.unionByName(settled)
        if done:
            return found
        long, accuracy = join_null_safe(long, lost_groups, keys), accuracy * 10


def _runs(long: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """(keys, __size, __zone, __exact, __n, __least, __most): each group in runs of ascending value."""
    margin = 2.0 / accuracy  # twice the sketch's own error, in shares of the rows
    levels = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = F.percentile_approx("__value", F.array(*[F.lit(x) for x in levels]), F.lit(accuracy))
    brackets = checkpointed(long.groupBy(*keys).agg(F.count("__value").alias("__size"), sketch.alias("__cuts")))
    small = len(keys) == 1  # one group a column
    if not small:
        n, text = brackets.agg(
            F.count(F.lit(1)), F.sum(sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0)))
        ).first()
        small = n * (64 + 8 * len(levels)) + (text or 0) <= BROADCAST_BYTES
    value = F.col("__value")
    opened = [(F.col("__cuts")[i] <= value).cast("int") for i in range(len(probs))]
    closed = [(F.col("__cuts")[len(probs) + i] < value).cast("int") for i in range(len(probs))]
    return (
        join_null_safe(long, F.broadcast(brackets) if small else brackets, keys)
        .select(*keys, "__size", "__value", reduce(add, opened).alias("__opened"), reduce(add, closed).alias("__closed"))
        .groupBy(
            *keys, (F.col("__opened") + F.col("__closed")).alias("__zone"),
            F.when(F.col("__opened") > F.col("__closed"), value).alias("__exact"),
        )
        .agg(F.first("__size").alias("__size"), F.count("__value").alias(_COUNT), F.min("__value").alias("__least"),
             F.max("__value").alias("__most"))
    )


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """Median per group, as plain columns."""
    found = quantiles(df, cols, [0.5], by, stored)
    return found.withColumns({c: F.element_at(F.col(c), 1) for c in cols})
