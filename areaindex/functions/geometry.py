"""Planar geometry as column expressions over an array of directed edges.

A polygon is a row with ``edges array<struct<x1,y1,x2,y2>>``: shells run
counter-clockwise and holes clockwise, all parts in one array. Sums over such
edges give areas and centroids of any polygon, with holes and parts, without
further bookkeeping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
RINGS_TYPE = "array<struct<is_hole:boolean,pts:array<struct<x:double,y:double>>>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _edge(p: Column, q: Column) -> Column:
    return F.struct(
        p["x"].cast("double").alias("x1"), p["y"].cast("double").alias("y1"),
        q["x"].cast("double").alias("x2"), q["y"].cast("double").alias("y2"),
    )


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def _total(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def ring_edges(pts: Column, is_hole: Column) -> Column:
    """Directed edges of one ring; closes it if needed and drops points repeated in a row."""
    following = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
    pairs = F.filter(F.zip_with(pts, following, _edge), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))

    def oriented(edges: Column) -> Column:
        turned = F.transform(edges, lambda e: F.struct(
            e["x2"].alias("x1"), e["y2"].alias("y1"), e["x1"].alias("x2"), e["y1"].alias("y2")
        ))
        wrong = (_total(edges, _cross) < 0) != F.coalesce(is_hole, F.lit(False))
        return F.when(wrong, turned).otherwise(edges)

    return let(pairs, oriented)


def rings_to_edges(rings: Column) -> Column:
    """Edges of all rings of a polygon or multi-part polygon."""
    return F.flatten(F.transform(rings, lambda r: ring_edges(r["pts"], r["is_hole"])))


def bounding_box(edges: Column) -> dict[str, Column]:
    """Outlines are closed, so the start points of the edges are all the vertices."""
    return {
        "xmin": F.array_min(edges["x1"]), "ymin": F.array_min(edges["y1"]),
        "xmax": F.array_max(edges["x1"]), "ymax": F.array_max(edges["y1"]),
    }


def _local(e: Column, x0: Column, y0: Column) -> Column:
    return F.struct(
        (e["x1"] - x0).alias("x1"), (e["y1"] - y0).alias("y1"),
        (e["x2"] - x0).alias("x2"), (e["y2"] - y0).alias("y2"),
    )


def area_and_centroid(edges: Column) -> Column:
    """struct<area, cx, cy>, measured from the first vertex to keep the sums small."""
    x0, y0 = edges[0]["x1"], edges[0]["y1"]

    def add(acc: Column, e: Column) -> Column:
        near = _local(e, x0, y0)
        c = _cross(near)
        return F.struct(
            (acc["a"] + c).alias("a"),
            (acc["sx"] + (near["x1"] + near["x2"]) * c).alias("sx"),
            (acc["sy"] + (near["y1"] + near["y2"]) * c).alias("sy"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def finish(acc: Column) -> Column:
        twice = F.nullif(acc["a"], F.lit(0.0))
        return F.struct(
            (acc["a"] / 2).alias("area"),
            (x0 + acc["sx"] / (twice * 3)).alias("cx"), (y0 + acc["sy"] / (twice * 3)).alias("cy"),
        )

    return F.aggregate(edges, zero, add, finish)


def crosses_ray(e: Column, px: Column, py: Column) -> Column:
    """Whether an edge crosses the ray from a point to the right."""
    spans = (e["y1"] > py) != (e["y2"] > py)
    at = e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    return spans & (px < at)


def contains_point(edges: Column, px: Column, py: Column) -> Column:
    """Ray crossing rule: an odd number of edges lies to the right of the point.

    Half-open in y, so a ray through a vertex counts once. Points exactly on
    the outline fall on either side, by the same rule for every polygon.
    """
    return F.size(F.filter(edges, lambda e: crosses_ray(e, px, py))) % 2 == 1


def _point_segment_sq(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - e["x1"] - t * dx, py - e["y1"] - t * dy
    return ex * ex + ey * ey


def outline_distance(edges: Column, px: Column, py: Column) -> Column:
    """Distance from a point to the nearest edge."""
    return F.sqrt(F.array_min(F.transform(edges, lambda e: _point_segment_sq(px, py, e))))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _within_box(e: Column, px: Column, py: Column) -> Column:
    return (
        px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def segments_touch(e: Column, f: Column) -> Column:
    """Whether two segments share a point, end points and collinear overlap included."""
    s1 = _side(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"])
    s2 = _side(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    s3 = _side(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"])
    s4 = _side(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    return (
        ((s1 != s2) & (s3 != s4))
        | ((s1 == 0) & _within_box(e, f["x1"], f["y1"]))
        | ((s2 == 0) & _within_box(e, f["x2"], f["y2"]))
        | ((s3 == 0) & _within_box(f, e["x1"], e["y1"]))
        | ((s4 == 0) & _within_box(f, e["x2"], e["y2"]))
    )


def outlines_touch(a: Column, b: Column) -> Column:
    """Whether any two edges share a point."""
    return F.exists(a, lambda e: F.exists(b, lambda f: segments_touch(e, f)))


def polygons_touch(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: crossing or touching outlines, or one inside the other."""
    outlines = outlines_touch(a, b)
    a_in_b = F.exists(a, lambda e: contains_point(b, e["x1"], e["y1"]))
    b_in_a = F.exists(b, lambda f: contains_point(a, f["x1"], f["y1"]))
    return outlines | a_in_b | b_in_a


def polygon_gap(a: Column, b: Column) -> Column:
    """Distance between two polygons that do not meet: closest vertex to edge, either way."""
    a_to_b = F.array_min(F.transform(a, lambda e: outline_distance(b, e["x1"], e["y1"])))
    b_to_a = F.array_min(F.transform(b, lambda f: outline_distance(a, f["x1"], f["y1"])))
    return F.least(a_to_b, b_to_a)


def area_under_lower(
    e: Column, f: Column, base_y: Column, low: Column | None = None, high: Column | None = None
) -> Column:
    """Signed area above ``base_y`` and under the lower of two slanted edges, where both run, and between ``low`` and ``high``."""
    def height(g: Column, x: Column) -> Column:
        return g["y1"] - base_y + (x - g["x1"]) * (g["y2"] - g["y1"]) / (g["x2"] - g["x1"])

    def sign(g: Column) -> Column:
        return F.when(g["x1"] > g["x2"], F.lit(1.0)).otherwise(F.lit(-1.0))

    lefts = [F.least(e["x1"], e["x2"]), F.least(f["x1"], f["x2"])]
    rights = [F.greatest(e["x1"], e["x2"]), F.greatest(f["x1"], f["x2"])]
    left = F.greatest(*lefts, *([] if low is None else [low]))
    right = F.least(*rights, *([] if high is None else [high]))
    width = right - left
    u, v = height(e, left) - height(f, left), height(e, right) - height(f, right)
    both = (height(e, left) + height(f, left) + height(e, right) + height(f, right)) / 2
    bent = (u * u + v * v) / (F.nullif(F.abs(u) + F.abs(v), F.lit(0.0)))
    apart = F.when(u * v >= 0, F.abs(u) + F.abs(v)).otherwise(bent) / 2
    return F.when(width > 0, sign(e) * sign(f) * width * (both - apart) / 2).otherwise(F.lit(0.0))


def shared_area(a: Column, b: Column, base_y: Column) -> Column:
    """Area common to two polygons, of any shape.

    With counter-clockwise shells a polygon is the signed sum of the trapezoids
    under its non-vertical edges, so the common area is the signed sum, over
    pairs of edges, of the area under the lower of the two edges. Heights are
    taken above ``base_y``, which must not lie above either polygon.
    """
    slanted_a = F.filter(a, lambda e: e["x1"] != e["x2"])
    slanted_b = F.filter(b, lambda f: f["x1"] != f["x2"])
    return F.aggregate(slanted_a, F.lit(0.0), lambda acc, e: acc + F.aggregate(
        slanted_b, F.lit(0.0), lambda inner, f: inner + area_under_lower(e, f, base_y)
    ))
