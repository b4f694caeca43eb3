"""k nearest points by grid cells: exact, and without comparing all with all."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaindex.functions.grid import CELL, cell_index, cells_covered, cells_of_point, explode_cells, level_for
from areaindex.session import checkpointed, join_measured

_DEEPEST = 24
_CELL_POINTS = 16
#: Cells along a side of the extent that a far-off place may look at.
_LONG_SIDE = 128


def _grid_levels(points: DataFrame, part: list[str], k: int) -> tuple[list[int], int, tuple]:
    """Levels of the grid, number of points and their extent (x0, y0, x1, y1).

    Cell sizes run from "few points in any cell" up to "everything in one cell".

    The finest size is the first at which even the fullest cell holds no more
    than a few points, so a dense cluster deepens the grid. Points are
    counted in the finest cells first, and only occupied cells are then rolled
    up; the sizes only steer the work, never the result.
    """
    row = points.agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
    ).first()
    if row["x0"] is None:
        return [0], 0, (0.0, 0.0, 0.0, 0.0)
    extent = max(row["x1"] - row["x0"], row["y1"] - row["y0"], 2.0 ** -10)
    top = math.ceil(math.log2(extent)) + 1
    bottom = top - _DEEPEST
    deepest = points.select(
        *part, cell_index(F.col("x"), F.lit(bottom)).alias("__cx"), cell_index(F.col("y"), F.lit(bottom)).alias("__cy")
    ).groupBy(*part, "__cx", "__cy").agg(F.count(F.lit(1)).alias("__n"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(_DEEPEST))).alias("__step")
    rolled = deepest.select(*part, "__cx", "__cy", "__n", steps)

    def coarser(c: str):
        return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__step"))).alias(c)

    rolled = rolled.select(*part, "__step", coarser("__cx"), coarser("__cy"), "__n")
    fullest = (
        rolled.groupBy(*part, "__step", "__cx", "__cy").agg(F.sum("__n").alias("__n"))
        .groupBy("__step").agg(F.max("__n").alias("n"), F.sum("__n").alias("total")).collect()
    )
    enough = [r["__step"] for r in fullest if r["n"] <= max(_CELL_POINTS, 4 * k)]
    return list(range(bottom + max(enough, default=1), top + 1)), fullest[0]["total"], tuple(row)


def _blocks(levels: list[int], x: Column, y: Column) -> Column:
    """The cells within half a cell side of a place at each level, and the root cell."""
    def block(level: Column) -> Column:
        half = F.pow(F.lit(2.0), level) / 2
        return cells_covered(x - half, y - half, x + half, y + half, level)

    sized = F.transform(F.array(*[F.lit(level) for level in levels[:-1]]), block)
    return F.concat(F.flatten(sized), _root(levels)) if len(levels) > 1 else _root(levels)


def _root(levels: list[int]) -> Column:
    """One pseudo-cell that stands for the whole plane."""
    zero = F.lit(0).cast("long")
    return F.array(F.struct(F.lit(levels[-1]).alias("cell_level"), zero.alias("cell_x"), zero.alias("cell_y")))


def _some_points(k: int) -> Column:
    """Up to ``k`` points of a group: the first of each of k classes by hash, so that groups are reduced before a shuffle."""
    kind = F.pmod(F.xxhash64("__pid", "x", "y"), F.lit(k))
    firsts = [F.min(F.when(kind == i, F.struct("__pid", "x", "y"))) for i in range(k)]
    return F.filter(F.array(*firsts), lambda p: p.isNotNull())


def _outermost_points(k: int) -> Column:
    """Points far out in eight directions, up to ``k`` each: what places outside the extent are near to."""
    kind, x, y = F.pmod(F.xxhash64("__pid", "x", "y"), F.lit(k)), F.col("x"), F.col("y")
    ways = (x, -x, y, -y, x + y, -x - y, x - y, y - x)
    firsts = [F.min(F.when(kind == i, F.struct(way.alias("way"), "__pid", "x", "y"))) for way in ways for i in range(k)]
    found = F.filter(F.array(*firsts), lambda p: p.isNotNull())
    return F.transform(found, lambda p: F.struct(p["__pid"].alias("__pid"), p["x"].alias("x"), p["y"].alias("y")))


def _cells_in_reach(extent: tuple, level: Column) -> Column:
    """The cells at ``level`` that the disk of a search shares with the extent of the points, column by column."""
    x0, y0, x1, y1 = (F.lit(v) for v in extent)
    size = F.pow(F.lit(2.0), level)
    r, x, y = F.col("reach"), F.col("qx"), F.col("qy")
    right = F.least(x + r, x1)
    left = F.least(F.greatest(x - r, x0), right)

    def column(cx: Column) -> Column:
        across = F.greatest(cx * size - x, x - (cx + 1) * size, F.lit(0.0))
        along = F.sqrt(F.greatest(r * r - across * across, F.lit(0.0))) * (1 + 1e-9) + 1e-9
        low, high = F.greatest(y - along, y0), F.least(y + along, y1)
        rows = F.when(low <= high, F.sequence(cell_index(low, level), cell_index(high, level)))
        return F.transform(
            F.coalesce(rows, F.array().cast("array<bigint>")),
            lambda cy: F.struct(level.alias("cell_level"), cx.alias("cell_x"), cy.alias("cell_y")),
        )

    return F.flatten(F.transform(F.sequence(cell_index(left, level), cell_index(right, level)), column))


def candidate_pairs(
    queries: DataFrame, points: DataFrame, k: int = 3, by: str | None = None, query_id: str = "area_code", point_id: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(queries by place, pairs of a place and a point that may be among its ``k`` nearest)."""
    part = [by] if by else []
    points = points.select(*part, F.col(point_id).alias("__pid"), F.col("x").cast("double"), F.col("y").cast("double"))
    points = points.na.drop("any", subset=["x", "y"])
    queries = queries.select(
        F.col(query_id), F.col("x").cast("double"), F.col("y").cast("double")
    ).na.drop("any", subset=["x", "y"])
    same_place = Window.partitionBy(*part, "x", "y").orderBy("__pid")
    # Stored, because measuring the grid and both joins read it.
    points = checkpointed(
        points.withColumn("__r", F.row_number().over(same_place)).where(F.col("__r") <= k).drop("__r")
    )
    levels, count, (x0, y0, x1, y1) = _grid_levels(points, part, k)
    filed_bytes = count * len(levels) * 100
    root, sized = levels[-1], levels[:-1]
    # A place becomes dozens of rows below, so places go to twice the partitions
    # of a plain shuffle, and a count given here is not coalesced away.
    tasks = 2 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = queries.select(F.col("x").alias("qx"), F.col("y").alias("qy")).distinct().repartition(tasks, "qx", "qy")

    # some points of every cell, as an array; the root cell stands for the whole plane
    cells = explode_cells(points, cells_of_point(F.col("x"), F.col("y"), sized) if sized else _root(levels))
    samples = cells.groupBy(*part, *CELL).agg(_some_points(k).alias("sample"))
    if sized:
        everywhere = points.groupBy(*part).agg(F.array_distinct(F.concat(_some_points(k), _outermost_points(k))).alias("sample"))
        samples = samples.unionByName(explode_cells(everywhere, _root(levels)))
    # a place outside the points' extent looks for samples from where it is nearest to it
    inside = [F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, lo, hi in (("qx", x0, x1), ("qy", y0, y1))]
    around = explode_cells(places, _blocks(levels, *inside))

    # The k-th nearest sample of a block bounds the search, where a block has k;
    # a block has up to four cells. At the root there may be fewer points than
    # k: then every point is within the bound.
    at_root = F.col("cell_level") == root
    gap = F.transform("sample", lambda p: (p["x"] - F.col("qx")) ** 2 + (p["y"] - F.col("qy")) ** 2)
    blocks = join_measured(around, samples, CELL, filed_bytes).groupBy(*part, "qx", "qy", "cell_level").agg(
        F.sort_array(F.flatten(F.collect_list(gap))).alias("gaps")
    )
    far_x = F.greatest(F.abs(F.col("qx") - x0), F.abs(F.col("qx") - x1))
    far_y = F.greatest(F.abs(F.col("qy") - y0), F.abs(F.col("qy") - y1))
    kth = F.coalesce(F.try_element_at("gaps", F.lit(k)), F.when(at_root, far_x * far_x + far_y * far_y))
    reach = blocks.groupBy(*part, "qx", "qy").agg(F.sqrt(F.min(kth)).alias("reach"))
    # A hair more than the bound itself, so that rounding cannot lose a point.
    reach = reach.withColumn("reach", F.col("reach") * (1 + 1e-9) + 1e-9)

    if sized:
        # What the search goes into the extent tells the size of its cells.
        off = F.sqrt(sum((F.col(q) - i) ** 2 for q, i in zip(("qx", "qy"), inside)))
        side = F.greatest((F.col("reach") - off) / 2, F.lit(max(x1 - x0, y1 - y0) / _LONG_SIDE) * (off > 0).cast("double"))
        level = F.least(F.greatest(level_for(side), F.lit(sized[0])), F.lit(sized[-1]))
        search = explode_cells(
            reach.withColumn("__level", level), _cells_in_reach((x0, y0, x1, y1), F.col("__level"))
        ).drop("__level")
    else:
        search = explode_cells(reach, _root(levels))
    return queries.withColumnsRenamed({"x": "qx", "y": "qy"}), join_measured(search, cells, [*part, *CELL], filed_bytes)


def knn_join(
    queries: DataFrame, points: DataFrame, k: int = 3, by: str | None = None, scale: float = 1000.0,
    query_id: str = "area_code", point_id: str = "id",
) -> DataFrame:
    """The ``k`` nearest points of every query, by Euclidean distance / ``scale``.

    Both frames have x, y; with ``by`` (a column of ``points``, such as the
    year) the search is made once per value of it. Equal distances are ordered
    by point id. Fewer than ``k`` points give fewer rows.

    Two joins on cells. The first looks at the block of up to 2 x 2 cells around
    each query place, at every cell size, through a few sample points per cell:
    the k-th nearest sample bounds the search. The second reads the cells within
    that bound. Points sharing a place are cut to the k lowest ids first, which
    cannot change a result because all of them are equally far from everything;
    queries sharing a place are searched once.
    """
    part = [by] if by else []
    placed, near = candidate_pairs(queries, points, k, by, query_id, point_id)
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    near = near.withColumn("__d", F.sqrt(dx * dx + dy * dy)).where(F.col("__d") <= F.col("reach"))
    nearest = Window.partitionBy(*part, "qx", "qy").orderBy("__d", "__pid")
    best = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    best = best.select(
        *part, "qx", "qy", "rank", F.col("__pid").alias(point_id), (F.col("__d") / F.lit(scale)).alias("distance")
    )
    return placed.join(best, ["qx", "qy"]).select(query_id, *part, "rank", point_id, "distance")


def distance_weighted(
    df: DataFrame, key: Sequence[str], metrics: Sequence[str], offset: float = 0.1,
    distance: str = "distance", name: str = "{}_weighted",
) -> DataFrame:
    """Mean of each metric weighted by 1 / (distance + offset), over the values present."""
    weight = 1 / (F.col(distance) + F.lit(offset))
    return df.groupBy(*key).agg(*[
        F.try_divide(F.sum(F.col(m) * weight), F.sum(F.when(F.col(m).isNotNull(), weight))).alias(name.format(m))
        for m in metrics
    ])


def to_rank_wide(
    df: DataFrame, key: Sequence[str], prefix: str, metrics: Sequence[str], k: int = 3,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per key, with ``{prefix}_{rank}_{metric}`` columns."""
    rename = rename or {}
    return df.groupBy(*key).agg(*[
        F.first(F.when(F.col("rank") == r, F.col(m)), ignorenulls=True).alias(f"{prefix}_{r}_{rename.get(m, m)}")
        for r in range(1, k + 1) for m in metrics
    ])


def to_rank_long(df: DataFrame, key: Sequence[str], prefix: str, metrics: Sequence[str], k: int = 3) -> DataFrame:
    """Rank-wide columns back to one row per rank; ranks without any value are left out."""
    rows = [
        F.struct(F.lit(r).alias("rank"), *[F.col(f"{prefix}_{r}_{m}").alias(m) for m in metrics])
        for r in range(1, k + 1)
    ]
    long = df.select(*key, F.explode(F.array(*rows)).alias("__s")).select(*key, "__s.*")
    return long.na.drop("all", subset=list(metrics))


def nearby_entities(
    df: DataFrame, name: str, entity: str, sort: str, metrics: Sequence[str],
    type_col: str | None = None, only: str | None = None, special: str = "IND",
) -> DataFrame:
    """Distinct entities listed for a set of areas, best first.

    ``only="special"`` keeps the entities of type ``special``, ``"other"`` the
    rest. An entity counts if its name and id are present; of several rows
    with one name the one with the lowest id stays.
    """
    valid = df.where(
        F.col(name).isNotNull() & (F.col(name) != "N/A") & (F.col(name) != "") & F.col(entity).isNotNull()
    )
    if type_col and only:
        is_special = F.upper(F.trim(F.coalesce(F.col(type_col).cast("string"), F.lit("NA")))) == special
        valid = valid.where(is_special if only == "special" else ~is_special)
    kept = [entity, *metrics, *([type_col] if type_col else [])]
    one = valid.groupBy(name).agg(
        F.min_by(F.struct(*kept), F.struct(entity, *metrics)).alias("__best")
    ).select(name, "__best.*")
    return one.orderBy(F.col(sort).desc_nulls_last(), name)
