"""Large polygons taken apart, so that no task works through all edges of one.

A polygon of up to ``LARGE`` edges stays an array in a row. The edges of a
larger one become rows, filed three ways:

* by bands in y, for points: only edges of a point's band can cross its ray;
  crossings are counted per point and polygon;
* by slabs in x, for common areas: two edges share area under them only within
  a slab that both have; partial areas are added up per pair;
* in chunks of consecutive edges with boxes of their own, for outlines that
  touch or lie near each other.

Bands and slabs are so wide that all their entries together number at most four
times the edges, whatever the shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions import geometry as G
from areaindex.session import checkpointed, join_measured

#: Edges that a polygon may have before it is taken apart, and edges of a chunk or, on average, of a band.
LARGE = 128
CHUNK = 64
#: Bytes of an edge as a row of a join, and the entries an edge makes on average at most.
_EDGE_BYTES, _ENTRIES = 72, 4


def is_large(edges: str = "edges") -> Column:
    return F.size(edges) > LARGE


def has_large(*frames: DataFrame, edges: str = "edges") -> bool:
    return any((df.agg(F.max(F.size(edges))).first()[0] or 0) > LARGE for df in frames)


def _step(edges: Column, first: str, second: str, extent: Column) -> Column:
    """Width of a band: ``CHUNK`` edges on average, and at most three entries an edge beyond its first."""
    run = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + F.abs(e[second] - e[first]))
    n = F.size(edges)
    return F.greatest(extent * CHUNK / n, run / (3 * n), F.lit(1e-300))


def _edge() -> Column:
    return F.struct("x1", "y1", "x2", "y2")


def points_in_large(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs (x, y, __poly, ...) in which the point lies inside polygon ``__poly`` of ``large`` (__poly, edges, ymin, ymax)."""
    heights = large.select("__poly", F.col("ymin").alias("__from"), _step(F.col("edges"), "y1", "y2", F.col("ymax") - F.col("ymin")).alias("__step"), "edges")
    n_edges = large.agg(F.sum(F.size("edges"))).first()[0] or 0

    def band(y: Column) -> Column:
        return F.floor((y - F.col("__from")) / F.col("__step"))

    rows = (
        heights.select("__poly", "__from", "__step", F.inline("edges")).where("y1 <> y2")
        .withColumn("__band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
        .select("__poly", "__band", _edge().alias("__edge"))
    )
    placed = join_measured(pairs, heights.drop("edges"), ["__poly"], 64 * large.count())
    # numbered and stored, because a pair meets several edges and repeats of a point are pairs of their own
    placed = checkpointed(
        placed.withColumns({"__band": band(F.col("y")), "__pair": F.monotonically_increasing_id()}).drop("__from", "__step")
    )
    met = join_measured(placed.select("__pair", "__poly", "__band", "x", "y"), rows, ["__poly", "__band"], _EDGE_BYTES * _ENTRIES * n_edges)
    odd = met.groupBy("__pair").agg((F.count_if(G.crosses_ray(F.col("__edge"), F.col("x"), F.col("y"))) % 2 == 1).alias("__inside"))
    return placed.join(odd.where("__inside").select("__pair"), "__pair", "left_semi").drop("__pair", "__band")


def with_slabs(polys: DataFrame) -> DataFrame:
    """Add ``slab``: the width of a large polygon's slabs, a power of two, so that slabs of any two polygons nest."""
    step = _step(F.col("edges"), "x1", "x2", F.col("xmax") - F.col("xmin"))
    return polys.withColumn("slab", F.when(is_large(), F.pow(F.lit(2.0), F.ceil(F.log2(step)))))


def _slab_rows(polys: DataFrame, side: str) -> DataFrame:
    """(side_id, side_at, side_edge): edges by slab; those of a polygon without slabs are all at 0."""
    def at(x: Column) -> Column:
        return F.coalesce(F.floor(x / F.col("slab")), F.lit(0))

    return (
        polys.select(f"{side}_id", "slab", F.inline(f"{side}_edges")).where("x1 <> x2")
        .withColumn(f"{side}_at", F.explode(F.sequence(at(F.least("x1", "x2")), at(F.greatest("x1", "x2")))))
        .select(f"{side}_id", f"{side}_at", _edge().alias(f"{side}_edge"))
    )


def slab_overlap(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, overlap) for pairs (a_id, b_id, a_slab, b_slab, left, right, base) of which one has slabs.

    ``a`` and ``b`` are (id, edges, slab) with prefixed ids and edges.
    """
    width = F.least("a_slab", "b_slab")
    cut = pairs.withColumn("__w", width).withColumn(
        "__s", F.explode(F.sequence(F.floor(F.col("left") / F.col("__w")), F.floor(F.col("right") / F.col("__w"))))
    )
    cut = cut.withColumns({"__lo": F.col("__s") * F.col("__w"), "__hi": (F.col("__s") + 1) * F.col("__w")})
    for side, polys in (("a", a), ("b", b)):
        n_edges = polys.agg(F.sum(F.size(f"{side}_edges"))).first()[0] or 0
        cut = cut.withColumn(f"{side}_at", F.coalesce(F.floor(F.col("__lo") / F.col(f"{side}_slab")), F.lit(0)))
        cut = join_measured(cut, _slab_rows(polys, side), [f"{side}_id", f"{side}_at"], _EDGE_BYTES * _ENTRIES * n_edges)
        e = F.col(f"{side}_edge")
        cut = cut.where((F.greatest(e["x1"], e["x2"]) > F.col("__lo")) & (F.least(e["x1"], e["x2"]) < F.col("__hi")))
    part = G.area_under_lower(F.col("a_edge"), F.col("b_edge"), F.col("base"), F.col("__lo"), F.col("__hi"))
    return cut.groupBy("a_id", "b_id").agg(F.sum(part).alias("overlap"))


def chunks(polys: DataFrame, edges: str = "edges") -> DataFrame:
    """One row per chunk of consecutive edges, with the chunk's own box; the other columns stay."""
    def parts(all_edges: Column) -> Column:
        n = F.when(is_large(edges), F.floor((F.size(all_edges) - 1) / CHUNK)).otherwise(F.lit(0)).cast("int")
        size = F.when(is_large(edges), F.lit(CHUNK)).otherwise(F.greatest(F.size(all_edges), F.lit(1)))
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(all_edges, i * size + 1, size))

    cut = polys.withColumn(edges, F.explode(parts(F.col(edges))))
    low, high = {}, {}
    for axis in ("x", "y"):
        ends = [F.col(edges)[f"{axis}{i}"] for i in (1, 2)]
        low[f"{axis}min"] = F.least(*[F.array_min(e) for e in ends])
        high[f"{axis}max"] = F.greatest(*[F.array_max(e) for e in ends])
    return cut.withColumns({**low, **high})


def sample_vertices(polys: DataFrame, id_col: str) -> DataFrame:
    """(id, x, y): the first vertex of every chunk."""
    return chunks(polys.select(id_col, "edges")).select(
        id_col, F.col("edges")[0]["x1"].alias("x"), F.col("edges")[0]["y1"].alias("y")
    ).dropDuplicates([id_col, "x", "y"])


def ring_starts(polys: DataFrame, edges: str) -> DataFrame:
    """``x``, ``y`` of the first vertex of each ring, with the other columns.

    Edges of a ring follow each other by an end point; where two rings share
    one, they are taken as one, and both lie on the same side of whatever
    touches neither.
    """
    all_edges = F.col(edges)

    def starts(e: Column, i: Column) -> Column:
        before = all_edges[F.greatest(i - 1, F.lit(0))]
        forward = (before["x2"] == e["x1"]) & (before["y2"] == e["y1"])
        backward = (before["x1"] == e["x2"]) & (before["y1"] == e["y2"])
        return (i == 0) | ~(forward | backward)

    first = polys.withColumn("__start", F.explode(F.filter(all_edges, starts)))
    return first.withColumns({"x": F.col("__start.x1"), "y": F.col("__start.y1")}).drop("__start", edges)
