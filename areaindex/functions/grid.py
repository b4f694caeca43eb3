"""Square cells at several sizes, as keys for spatial equi-joins.

Level ``l`` has cells of side 2**l. A shape is filed at the level whose cells
are at least as wide as its bounding box, so it covers four cells at most
whatever its size, and no cell size has to be tuned to the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LEVEL = -20


def level_for(extent: Column) -> Column:
    """Smallest level whose cell side is at least ``extent``."""
    raw = F.ceil(F.log2(F.greatest(extent, F.lit(2.0 ** MIN_LEVEL)))).cast("int")
    # log2 may land one step low on an exact power of two.
    return F.when(F.pow(F.lit(2.0), raw) < extent, raw + 1).otherwise(raw)


def cell_index(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def cells_covered(xmin: Column, ymin: Column, xmax: Column, ymax: Column, level: Column) -> Column:
    """array<struct<cell_level,cell_x,cell_y>> of the cells that a box touches at ``level``."""
    columns = F.sequence(cell_index(xmin, level), cell_index(xmax, level))
    rows = F.sequence(cell_index(ymin, level), cell_index(ymax, level))
    return F.flatten(F.transform(columns, lambda cx: F.transform(
        rows, lambda cy: F.struct(level.alias("cell_level"), cx.alias("cell_x"), cy.alias("cell_y"))
    )))


def cells_of_point(x: Column, y: Column, levels: Sequence[int]) -> Column:
    """The cell of a point at each of ``levels``."""
    return F.transform(F.array(*[F.lit(int(i)) for i in levels]), lambda lv: F.struct(
        lv.alias("cell_level"), cell_index(x, lv).alias("cell_x"), cell_index(y, lv).alias("cell_y")
    ))


def box_level(df: DataFrame) -> Column:
    return level_for(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))


@dataclass(frozen=True)
class Extent:
    """What one pass over polygons tells: levels in use, rows, and bytes once filed by cell."""

    levels: list[int]
    rows: int
    filed_bytes: int


def measure(df: DataFrame, level: Column) -> Extent:
    """A level is a power of two, so there are some dozens of them at most.

    A row is sized by what it holds: 48 bytes an edge, the length of texts, 16
    bytes for any other column.
    """
    width = F.lit(32 + 16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            width = width + F.greatest(F.size(f"`{f.name}`"), F.lit(0)) * 48
        elif f.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
    found = df.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")
    ).where(F.col("level").isNotNull()).collect()
    # Up to four cells each.
    return Extent(sorted(r["level"] for r in found), sum(r["n"] for r in found), 4 * sum(r["bytes"] for r in found))


def explode_cells(df: DataFrame, cells: Column) -> DataFrame:
    """One row per cell, with columns cell_level, cell_x, cell_y."""
    return df.withColumn("__cell", F.explode(cells)).select(
        "*", "__cell.*"
    ).drop("__cell")


CELL = ["cell_level", "cell_x", "cell_y"]
