"""Spatial joins and measures over polygon rows (see ``functions.geometry``).

Polygon frames hold an id, ``edges`` and the bounding box ``xmin, ymin, xmax,
ymax``. Candidates always come from an equi-join on grid cells, so nothing is
compared with everything. The geometry test runs inside that join as long as
polygons are small; larger ones are taken apart (see ``bands``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaindex.functions import clean
from areaindex.functions import geometry as G
from areaindex.functions.grid import CELL, box_level, cells_covered, cells_of_point, explode_cells, measure
from areaindex.operators import bands
from areaindex.operators.knn import knn_join
from areaindex.session import checkpointed, join_measured, spread

BOX = ["xmin", "ymin", "xmax", "ymax"]


def with_box(df: DataFrame) -> DataFrame:
    """Add the bounding box to rows that have ``edges``."""
    return df.withColumns(G.bounding_box(F.col("edges")))


def polygons_from_rings(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygon rows from ring arrays; orientation is put right on the way."""
    return with_box(df.withColumn("edges", G.rings_to_edges(F.col(rings))).drop(rings))


def edge_table(polys: DataFrame, id_col: str) -> DataFrame:
    """One row per edge, for those who want to work on edges as a table."""
    return polys.select(id_col, F.posexplode("edges").alias("seq", "e")).select(id_col, "seq", "e.*")


def polygon_measures(polys: DataFrame) -> DataFrame:
    """Area and centroid of every polygon, added as area, cx, cy."""
    return (
        polys.withColumn("__m", G.area_and_centroid(F.col("edges")))
        .select(*polys.columns, "__m.area", "__m.cx", "__m.cy")
    )


def bounds(polys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bounding box of all polygons, or of each group of them."""
    return polys.groupBy(*by).agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )


def _box_cells(polys: DataFrame) -> DataFrame:
    level = box_level(polys)
    return explode_cells(polys, cells_covered(*[F.col(c) for c in BOX], level))


def _in_box(x: Column, y: Column) -> Column:
    return x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))


def _points_in_boxes(points: DataFrame, boxes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point (x, y) and a box holding it; each pair once. Columns ``on`` must agree."""
    extent = measure(boxes, box_level(boxes))
    located = explode_cells(points, cells_of_point(F.col("x"), F.col("y"), extent.levels))
    found = join_measured(located, _box_cells(boxes), [*on, *CELL], extent.filed_bytes)
    return found.where(_in_box(F.col("x"), F.col("y"))).drop(*CELL)


def points_in_polygons(points: DataFrame, polys: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each point with every polygon that contains it.

    ``points`` has x, y; ``polys`` keeps its columns other than the geometry.
    """
    gone = ["edges", *[c for c in BOX if c not in keep]]

    def within(small: DataFrame) -> DataFrame:
        pairs = _points_in_boxes(points, small)
        return pairs.where(G.contains_point(F.col("edges"), F.col("x"), F.col("y"))).drop(*gone)

    if not bands.has_large(polys):
        return within(polys)
    large = checkpointed(polys.where(bands.is_large()).withColumn("__poly", F.monotonically_increasing_id()))
    inside = bands.points_in_large(_points_in_boxes(points, large.drop("edges")), large)
    return within(polys.where(~bands.is_large())).unionByName(inside.drop("__poly", *gone))


def _nearest_reach(
    polys: DataFrame, id_col: str, points: DataFrame, point_id: str, by: str | None = None
) -> DataFrame:
    """Chunks of polygons with a box grown by a distance within which a point is certain to lie.

    Vertices belong to the polygon, so the point nearest to one of them bounds
    the distance from the polygon to its own nearest point. One vertex of every
    chunk is asked, the best bound holds for all chunks.
    """
    vertex = checkpointed(
        bands.sample_vertices(polys, id_col).withColumn("__vertex", F.struct(id_col, "x", "y"))
    ) if bands.has_large(polys) else polys.select(
        id_col, F.col("edges")[0]["x1"].alias("x"), F.col("edges")[0]["y1"].alias("y"), F.col(id_col).alias("__vertex")
    ).dropDuplicates([id_col])
    part = [by] if by else []
    asked = vertex.select(F.col("__vertex").alias("__query"), "x", "y")
    found = knn_join(asked, points, k=1, by=by, scale=1.0, query_id="__query", point_id=point_id)
    reach = (
        found.join(vertex.select(id_col, F.col("__vertex").alias("__query")), "__query")
        .groupBy(id_col, *part).agg(F.min("distance").alias("__reach"))
    )
    # Stored, because choosing the cell sizes and the join itself both read it.
    grown = bands.chunks(polys).join(reach, [id_col, *part])
    # A hair more than the bound itself, so that rounding cannot lose the point.
    slack = F.col("__reach") * (1 + 1e-9) + 1e-9
    return checkpointed(grown.withColumns({
        "xmin": F.col("xmin") - slack, "ymin": F.col("ymin") - slack,
        "xmax": F.col("xmax") + slack, "ymax": F.col("ymax") + slack,
    }))


def outline_pairs(
    polys: DataFrame, points: DataFrame, id_col: str, point_id: str, by: str | None = None
) -> DataFrame:
    """(chunk of a polygon, point) pairs that can hold the nearest point of a polygon, by reach."""
    part = [by] if by else []
    reach = _nearest_reach(polys, id_col, points.select(point_id, *part, "x", "y"), point_id, by)
    return _points_in_boxes(points, reach, part)


def nearest_points(
    polys: DataFrame, points: DataFrame, id_col: str, point_id: str, by: str | None = None, none_inside: bool = False
) -> DataFrame:
    """For each polygon, the point or points nearest to it (0 inside); ties stay.

    With ``by``, a column of both frames, only points of the same value count.
    ``none_inside`` says that no point lies inside. Adds ``distance``.
    """
    part = [by] if by else []
    x, y = F.col("x"), F.col("y")
    away = F.round(G.outline_distance(F.col("edges"), x, y), 9)
    pairs = outline_pairs(polys, points, id_col, point_id, by)
    measured = pairs.withColumn("distance", away).drop("edges", "__reach", *BOX)
    if not none_inside:
        inside = points_in_polygons(points, polys.drop(*part) if by else polys)
        if by:
            inside = inside.join(polys.select(id_col, by).distinct(), [id_col, by], "left_semi")
        measured = measured.unionByName(inside.withColumn("distance", F.lit(0.0)).select(*measured.columns))
    closest = Window.partitionBy(id_col, *part).orderBy("distance")
    near = measured.withColumn("__r", F.rank().over(closest)).where("__r = 1").drop("__r")
    return near.dropDuplicates([id_col, *part, point_id])


def mean_in_or_nearest(
    points: DataFrame, polys: DataFrame, value: str, id_col: str = "area_code", point_id: str = "id",
    by: str | None = None,
) -> DataFrame:
    """Mean value of the points inside each polygon, else of the nearest point(s).

    With ``by`` (such as the year of a reading) once per value of that column.
    """
    part = [by] if by else []
    shapes = polys.select(id_col, "edges", *BOX)
    inside = points_in_polygons(points.select(*part, "x", "y", value), shapes)
    # One row per polygon, stored: the points are then joined only once.
    means = checkpointed(
        inside.groupBy(id_col, *part).agg(F.avg(value).alias(value), F.count(value).alias("points"))
    )
    if by:
        shapes = shapes.withColumn(by, F.explode(points.agg(F.collect_set(by)).scalar()))
    without = shapes.join(means.select(id_col, *part), [id_col, *part], "left_anti")
    near = nearest_points(without, points.select(point_id, *part, "x", "y", value), id_col, point_id, by, True)
    fallback = near.groupBy(id_col, *part).agg(F.avg(value).alias(value), F.lit(0).cast("long").alias("points"))
    return means.unionByName(fallback)


def _box_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows whose boxes meet; each pair once.

    Columns of ``a`` and ``b`` must differ, but for the boxes, which are
    prefixed a_ and b_. Every box is filed at its own level and at the coarser
    levels that the other side uses; a pair meets at the coarser of its two
    levels, and counts only in the cell of the lower-left corner of what the
    boxes share.
    """
    a = a.withColumn("__la", box_level(a))
    b = b.withColumn("__lb", box_level(b))
    a_extent, b_extent = measure(a, F.col("__la")), measure(b, F.col("__lb"))
    # Geometry tests follow the join, in the tasks of the larger side.
    a_larger = a_extent.filed_bytes >= b_extent.filed_bytes
    if a_larger:
        a = spread(a, a_extent.rows, *BOX)
    else:
        b = spread(b, b_extent.rows, *BOX)

    def file(df: DataFrame, side: str, others: list[int]) -> DataFrame:
        own = F.col(f"__l{side}")
        coarser = F.filter(F.array(*[F.lit(i) for i in others]), lambda lv: lv > own)
        levels = F.concat(F.array(own), coarser)
        box = [F.col(c) for c in BOX]
        cells = F.flatten(F.transform(levels, lambda lv: cells_covered(*box, lv)))
        return explode_cells(df, cells).withColumnsRenamed({c: f"{side}_{c}" for c in BOX})

    sides = file(a, "a", b_extent.levels), file(b, "b", a_extent.levels)
    large, small = sides if a_larger else sides[::-1]
    copies = 1 + len(a_extent.levels if a_larger else b_extent.levels)
    small_bytes = copies * (b_extent if a_larger else a_extent).filed_bytes
    pairs = join_measured(large, small, CELL, small_bytes)
    left, low = F.greatest("a_xmin", "b_xmin"), F.greatest("a_ymin", "b_ymin")
    meet = (left <= F.least("a_xmax", "b_xmax")) & (low <= F.least("a_ymax", "b_ymax"))
    side = F.pow(F.lit(2.0), F.col("cell_level"))
    here = (F.floor(left / side) == F.col("cell_x")) & (F.floor(low / side) == F.col("cell_y"))
    coarser_of_both = F.col("cell_level") == F.greatest("__la", "__lb")
    return pairs.where(coarser_of_both & meet & here).drop(*CELL, "__la", "__lb")


def _sides(a: DataFrame, a_id: str, b: DataFrame, b_id: str) -> tuple[DataFrame, DataFrame]:
    left = a.select(F.col(a_id).alias("a_id"), F.col("edges").alias("a_edges"), *BOX)
    right = b.select(F.col(b_id).alias("b_id"), F.col("edges").alias("b_edges"), *BOX)
    return left, right


def _small(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.where(~bands.is_large("a_edges")), b.where(~bands.is_large("b_edges"))


def _either_large(a: DataFrame, b: DataFrame) -> bool:
    return bands.has_large(a, edges="a_edges") or bands.has_large(b, edges="b_edges")


def _large_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of polygons that share a point, of which one is large at least."""
    a, b = (df.withColumn(f"{s}_large", bands.is_large(f"{s}_edges")) for df, s in ((a, "a"), (b, "b")))
    one_large = F.col("a_large") | F.col("b_large")
    ids = ["a_id", "b_id"]
    outlines = _box_pairs(bands.chunks(a, "a_edges"), bands.chunks(b, "b_edges")).where(one_large)
    met = outlines.where(G.outlines_touch(F.col("a_edges"), F.col("b_edges"))).select(*ids)
    a_starts = bands.ring_starts(a.drop(*BOX), "a_edges")
    b_starts = bands.ring_starts(b.drop(*BOX), "b_edges")
    a_in_b = points_in_polygons(a_starts, b.withColumnRenamed("b_edges", "edges")).where(one_large).select(*ids)
    b_in_a = points_in_polygons(b_starts, a.withColumnRenamed("a_edges", "edges")).where(one_large).select(*ids)
    return met.unionByName(a_in_b).unionByName(b_in_a).distinct()


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of polygons that share at least one point."""
    def small(a: DataFrame, b: DataFrame) -> DataFrame:
        return _box_pairs(a, b).where(G.polygons_touch(F.col("a_edges"), F.col("b_edges"))).select("a_id", "b_id")

    if not _either_large(left, right):
        return small(left, right)
    return small(*_small(left, right)).unionByName(_large_pairs(left, right))


def intersecting(a: DataFrame, b: DataFrame, a_id: str = "area_code", b_id: str | None = None) -> DataFrame:
    """Pairs (a_id, b_id) of polygons that share at least one point."""
    return _meeting(*_sides(a, a_id, b, b_id or a_id))


def neighbours(polys: DataFrame, id_col: str = "area_code") -> DataFrame:
    """Areas that touch each area, the area itself left out."""
    return intersecting(polys, polys, id_col).where("a_id <> b_id").select(
        F.col("a_id").alias(id_col), F.col("b_id").alias("neighbour")
    )


def within_distance(polys: DataFrame, mask: DataFrame, reach: float, id_col: str = "area_code") -> DataFrame:
    """Ids of polygons that meet the mask or lie at most ``reach`` away from it."""
    def near(a: DataFrame, b: DataFrame, test: Column) -> DataFrame:
        grown = b.withColumns({c: F.col(c) - reach for c in BOX[:2]}).withColumns({c: F.col(c) + reach for c in BOX[2:]})
        return _box_pairs(a, grown).where(test).select("a_id")

    left, right = _sides(polys, id_col, mask.withColumn("__mask", F.monotonically_increasing_id()), "__mask")
    a, b = F.col("a_edges"), F.col("b_edges")
    close = G.polygon_gap(a, b) <= reach
    if not _either_large(left, right):
        found = near(left, right, G.polygons_touch(a, b) | close)
    else:
        found = _meeting(left, right).select("a_id").unionByName(
            near(bands.chunks(left, "a_edges"), bands.chunks(right, "b_edges"), close)
        )
    return found.select(F.col("a_id").alias(id_col)).distinct()


def _unless_noise(total: Column) -> Column:
    """Common area of a pair; what is within rounding error of nothing is nothing."""
    base = F.least("a_ymin", "b_ymin")
    width = F.least(F.col("a_xmax") - F.col("a_xmin"), F.col("b_xmax") - F.col("b_xmin"))
    noise = width * (F.greatest("a_ymax", "b_ymax") - base) * 1e-12
    return G.let(total, lambda v: F.when(v > noise, v).otherwise(F.lit(0.0)))


def _shared() -> Column:
    """Common area of a pair whose edges are in the row."""
    return _unless_noise(G.shared_area(F.col("a_edges"), F.col("b_edges"), F.least("a_ymin", "b_ymin")))


def _large_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_id, b_id, overlap) of the pairs whose boxes meet and of which one is large at least."""
    a, b = (
        bands.with_slabs(df.withColumnRenamed(f"{s}_edges", "edges")).withColumnRenamed("edges", f"{s}_edges")
        for df, s in ((left, "a"), (right, "b"))
    )
    pairs = _box_pairs(*(df.drop(f"{s}_edges").withColumnRenamed("slab", f"{s}_slab") for df, s in ((a, "a"), (b, "b"))))
    pairs = checkpointed(pairs.where("a_slab IS NOT NULL OR b_slab IS NOT NULL").withColumns({
        "left": F.greatest("a_xmin", "b_xmin"), "right": F.least("a_xmax", "b_xmax"), "base": F.least("a_ymin", "b_ymin"),
    }))
    added = bands.slab_overlap(pairs.select("a_id", "b_id", "a_slab", "b_slab", "left", "right", "base"), a, b)
    return pairs.join(added, ["a_id", "b_id"], "left").select(
        "a_id", "b_id", _unless_noise(F.coalesce("overlap", F.lit(0.0))).alias("overlap")
    )


def overlap_area(a: DataFrame, b: DataFrame, a_id: str = "area_code", b_id: str | None = None) -> DataFrame:
    """Area shared by each overlapping pair: a_id, b_id, overlap."""
    left, right = _sides(a, a_id, b, b_id or a_id)

    def small(a: DataFrame, b: DataFrame) -> DataFrame:
        return _box_pairs(a, b).withColumn("overlap", _shared()).select("a_id", "b_id", "overlap")

    if not _either_large(left, right):
        found = small(left, right)
    else:
        found = small(*_small(left, right)).unionByName(_large_overlaps(left, right))
    return found.where("overlap > 0")


def coverage_pct(
    areas: DataFrame, cover: DataFrame, id_col: str = "area_code", cover_id: str = "id",
    out: str = "coverage_pct",
) -> DataFrame:
    """Covered share of each area in percent, 0 where nothing covers it.

    Cover polygons that overlap each other count once each, so a share may
    exceed 100.
    """
    covered = overlap_area(areas, cover, id_col, cover_id).groupBy(F.col("a_id").alias(id_col)).agg(
        F.sum("overlap").alias("__covered")
    )
    measured = polygon_measures(areas).select(id_col, "area")
    share = F.coalesce(F.col("__covered"), F.lit(0.0)) / F.nullif(F.col("area"), F.lit(0.0)) * 100
    return measured.join(covered, id_col, "left").select(id_col, F.coalesce(share, F.lit(0.0)).alias(out))


def restrict_to(
    polys: DataFrame, mask: DataFrame, id_col: str = "area_code", mask_id: str = "id"
) -> DataFrame:
    """Polygons that meet the mask, with the area that lies within it."""
    left, right = _sides(polys, id_col, mask, mask_id)

    def small(a: DataFrame, b: DataFrame) -> DataFrame:
        met = _box_pairs(a, b).where(G.polygons_touch(F.col("a_edges"), F.col("b_edges")))
        return met.select("a_id", _shared().alias("overlap"))

    if not _either_large(left, right):
        met = small(left, right)
    else:
        large = _large_pairs(left, right).join(_large_overlaps(left, right), ["a_id", "b_id"], "left")
        met = small(*_small(left, right)).unionByName(large.select("a_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap")))
    within = met.groupBy(F.col("a_id").alias(id_col)).agg(F.sum("overlap").alias("area_within"))
    return polys.join(within, id_col)


def _nearest_polygons(child: DataFrame, parent: DataFrame, child_id: str, parent_id: str) -> DataFrame:
    corner = bands.sample_vertices(parent, parent_id).withColumn("__corner", F.struct(parent_id, "x", "y"))
    reach = _nearest_reach(child, child_id, corner, "__corner")
    left, right = _sides(reach, child_id, bands.chunks(parent), parent_id)
    pairs = _box_pairs(left, right).select(
        "a_id", "b_id", F.round(G.polygon_gap(F.col("a_edges"), F.col("b_edges")), 9).alias("gap")
    )
    return pairs.groupBy(F.col("a_id").alias(child_id)).agg(
        F.min_by("b_id", F.struct("gap", "b_id")).alias("__nearest")
    )


def _candidate_parents(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(a_id, b_id, overlap, within, central) of children (with area, cx, cy) and parents whose boxes meet."""
    within = (F.col("overlap") >= F.col("area") * (1 - tolerance)).alias("within")

    def small(a: DataFrame, b: DataFrame) -> DataFrame:
        return _box_pairs(a, b).withColumn("overlap", _shared()).select(
            "a_id", "b_id", "overlap", within, G.contains_point(F.col("b_edges"), F.col("cx"), F.col("cy")).alias("central"),
        )

    if not _either_large(left, right):
        return small(left, right)
    centres = left.select("a_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    held = points_in_polygons(centres, right.withColumnRenamed("b_edges", "edges")).select("a_id", "b_id", F.lit(True).alias("central"))
    large = _large_overlaps(left.drop("area", "cx", "cy"), right).join(left.select("a_id", "area"), "a_id")
    return small(*_small(left, right)).unionByName(
        large.join(held, ["a_id", "b_id"], "left")
        .select("a_id", "b_id", "overlap", within, F.coalesce("central", F.lit(False)).alias("central"))
    )


def assign_parent(
    child: DataFrame, parent: DataFrame, child_id: str = "area_code", parent_id: str = "parent_code",
    tolerance: float = 1e-9,
) -> DataFrame:
    """One parent per child: the one it lies within, else the one holding its
    centroid, else the one sharing most area, else the nearest.

    The first three rules come from one join and one aggregate. Equal
    candidates are settled by the lowest parent id.
    """
    measured = polygon_measures(child.select(child_id, "edges", *BOX))
    left = measured.select(
        F.col(child_id).alias("a_id"), F.col("edges").alias("a_edges"), "area", "cx", "cy", *BOX
    )
    right = parent.select(F.col(parent_id).alias("b_id"), F.col("edges").alias("b_edges"), *BOX)
    pairs = _candidate_parents(left, right, tolerance)
    # One row per child, stored: the pairs are then measured only once.
    found = checkpointed(pairs.groupBy(F.col("a_id").alias(child_id)).agg(
        F.min(F.when(F.col("within"), F.col("b_id"))).alias("__within"),
        F.min(F.when(F.col("central"), F.col("b_id"))).alias("__central"),
        F.min_by(
            F.when(F.col("overlap") > 0, F.col("b_id")), F.struct(-F.round("overlap", 6), F.col("b_id"))
        ).alias("__largest"),
    ).withColumn("__found", F.coalesce("__within", "__central", "__largest")).where("__found IS NOT NULL"))
    rest = child.select(child_id, "edges", *BOX).join(found, child_id, "left_anti")
    rule = (
        F.when(F.col("__within").isNotNull(), "within")
        .when(F.col("__central").isNotNull(), "centroid").otherwise("overlap")
    )
    settled = found.select(child_id, F.col("__found").alias(parent_id), rule.alias("rule"))
    nearest = _nearest_polygons(rest, parent, child_id, parent_id).select(
        child_id, F.col("__nearest").alias(parent_id), F.lit("nearest").alias("rule")
    )
    return settled.unionByName(nearest)


def locate_point(points: DataFrame, polys: DataFrame, hierarchy: DataFrame, id_col: str = "area_code") -> DataFrame:
    """Area that contains each point, with its parents; points outside every area stay, with NULL."""
    found = points_in_polygons(points, polys.select(id_col, "edges", *BOX))
    chained = found.join(hierarchy, id_col, "left")
    return points.join(chained.drop("x", "y"), [c for c in points.columns if c not in ("x", "y")], "left")


def locate_postcode(
    asked: DataFrame, places: DataFrame, polys: DataFrame, hierarchy: DataFrame, id_col: str = "area_code", postcode: str = "postcode",
) -> DataFrame:
    """Area and parents of every postcode asked for, however it is written; unknown ones stay, with NULL.

    ``places`` has the postcode with x and y. Postcodes are compared in their
    normal form; of several places of one, that of the least x, then y, holds.
    """
    known = places.groupBy(clean.norm_postcode(postcode).alias("__code")).agg(F.min(F.struct("x", "y")).alias("__at"))
    coded = asked.withColumn("__code", clean.norm_postcode(postcode))
    wanted = known.join(coded.select("__code").distinct(), "__code").select("__code", "__at.x", "__at.y")
    found = locate_point(wanted, polys, hierarchy, id_col)
    return coded.join(found, "__code", "left").drop("__code", "x", "y")
