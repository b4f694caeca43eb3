"""Large polygons: taken apart they give what they give in a row, and the work is bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tests.test_geometry as plain
from areaindex.functions import geometry as G
from areaindex.operators import bands, spatial
from tests.test_geometry import SHAPES, box, polygons, ring


@pytest.fixture
def apart(monkeypatch):
    """Every polygon is large, a chunk is two edges."""
    monkeypatch.setattr(bands, "LARGE", 2)
    monkeypatch.setattr(bands, "CHUNK", 2)


@pytest.mark.parametrize("name", [
    "test_points_in_polygons", "test_a_vertex_ray_counts_once", "test_neighbours_and_touching", "test_overlap", "test_coverage",
    "test_mean_in_or_nearest", "test_assign_parent", "test_within_distance",
])
def test_plain_cases_hold(spark, apart, name):
    cases = [getattr(plain, n) for n in dir(plain) if n.startswith(name)]
    assert cases
    for case in cases:
        case(spark)


def wavy(cx, cy, r, n, waves, depth, seed=0, hole=False):
    rng = np.random.default_rng(seed)
    at = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = r * (1 + depth * np.sin(waves * at) + 0.02 * rng.random(n))
    return ring(*zip(cx + radius * np.cos(at), cy + radius * np.sin(at)), hole=hole)


def comb(x, y, teeth, height):
    """Long vertical edges, all within every band."""
    pts = []
    for i in range(teeth):
        pts += [(x + 2 * i, y + height), (x + 2 * i + 1, y + height), (x + 2 * i + 1, y + 1), (x + 2 * i + 2, y + 1)]
    return ring(*pts[:-1], (x + 2 * teeth - 1, y), (x, y))


LARGE_SHAPES = {
    "lake": [wavy(0, 0, 50, 700, 9, .3), wavy(0, 0, 20, 300, 5, .2, 1, hole=True), wavy(0, 0, 8, 150, 3, .1, 2)],
    "coast": [wavy(60, 10, 40, 900, 30, .4, 3)], "comb": [comb(-100, -60, 100, 40)], "isles": [wavy(200 + 30 * i, 0, 10, 140, 4, .2, i) for i in range(3)],
    "small": [box(-3, -3, 6)], "in hole": [box(11, 0, 2)], "wide": [box(-300, -300, 900)], "far": [box(500, 500, 3)],
}


def test_against_whole_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-150, -80], [300, 80], (4000, 2)))]
    points = spark.createDataFrame(rows, "id int, x double, y double").withColumn("v", F.col("id") % 7)
    points = points.unionByName(points.where("id < 50"))  # repeats stay apart
    children = {f"c{i}": [box(x, y, 9)] for i, (x, y) in enumerate(rng.uniform([-150, -80], [300, 80], (60, 2)))}
    found = {}
    for large in (64, 10**9):
        monkeypatch.setattr(bands, "LARGE", large)
        polys = polygons(spark, LARGE_SHAPES)
        kids, tall = polygons(spark, children), polygons(spark, LARGE_SHAPES, "parent_code")
        assert bands.has_large(polys) == (large == 64)
        inside = spatial.points_in_polygons(points, polys, keep=("xmin",))
        mean = spatial.mean_in_or_nearest(points.where("id % 40 = 0"), polys, "v")
        apart = {n: v for n, v in LARGE_SHAPES.items() if n != "wide"}
        parents = spatial.assign_parent(kids, polygons(spark, apart, "parent_code"))
        found[large] = {
            "inside": sorted(map(tuple, inside.select("id", "area_code", "v", "xmin").collect())),
            "meet": sorted(map(tuple, spatial.intersecting(polys, kids).collect())),
            "neighbours": sorted(map(tuple, spatial.neighbours(polys).collect())),
            "overlap": {(r[0], r[1]): r[2] for r in spatial.overlap_area(polys, tall, "area_code", "parent_code").collect()},
            "restrict": {r.area_code: r.area_within for r in spatial.restrict_to(kids, tall, "area_code", "parent_code").collect()},
            "near": sorted(r[0] for r in spatial.within_distance(kids, polys.where("area_code in ('lake', 'coast')"), 7.0).collect()),
            "mean": {r.area_code: (r.v, r.points) for r in mean.collect()},
            "parents": sorted(map(tuple, parents.select("area_code", "parent_code", "rule").collect())),
            "covered": {r[0]: r[1] for r in spatial.coverage_pct(kids, polys, "area_code", "area_code").collect()},
        }
    got, want = found.values()
    assert len(want["inside"]) > 4000 and {r for *_, r in want["parents"]} == {"within", "centroid", "overlap", "nearest"}
    for name in want:
        if isinstance(want[name], dict):
            assert got[name].keys() == want[name].keys(), name
            for k, v in want[name].items():
                assert got[name][k] == pytest.approx(v, rel=1e-9, abs=1e-7), (name, k)
        else:
            assert got[name] == want[name], name


def test_a_polygon_and_points_of_a_hundred_thousand(spark):
    """Band entries stay below four an edge, a point meets few edges, and the edges are dealt to many tasks."""
    n = 100_000
    at = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 1000 * (1 + .3 * np.sin(40 * at))
    pts = np.column_stack([radius * np.cos(at), radius * np.sin(at)])
    shape = polygons(spark, {"coast": [{"is_hole": False, "pts": [{"x": float(x), "y": float(y)} for x, y in pts]}]})
    rng = np.random.default_rng(2)
    places = rng.uniform(-1300, 1300, (n, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id int, x double, y double")
    got = {r.id for r in spatial.points_in_polygons(points, shape).select("id").collect()}
    angle = np.arctan2(places[:, 1], places[:, 0]) % (2 * np.pi)
    gap = np.hypot(*places.T) - 1000 * (1 + .3 * np.sin(40 * angle))
    sure = np.abs(gap) > 1e-2
    assert {int(i) for i in np.flatnonzero(sure & (gap < 0))} == {i for i in got if sure[i]}
    step = shape.select(bands._step(F.col("edges"), "y1", "y2", F.col("ymax") - F.col("ymin"))).first()[0]
    assert np.ceil(np.abs(np.diff(np.r_[pts[:, 1], pts[0, 1]])) / step + 1).sum() <= 4 * n + n


def test_band_entries_are_bounded_for_any_shape(spark):
    polys = polygons(spark, LARGE_SHAPES).where(bands.is_large())
    for r in polys.select("edges", bands._step(F.col("edges"), "y1", "y2", F.col("ymax") - F.col("ymin")).alias("s"), "ymin").collect():
        entries = sum(np.floor((max(e.y1, e.y2) - r.ymin) / r.s) - np.floor((min(e.y1, e.y2) - r.ymin) / r.s) + 1 for e in r.edges)
        assert entries <= 4 * len(r.edges) + len(r.edges) * .1


def test_nearest_reads_few_points(spark):
    """A large polygon looks only around its outline, not across its own width."""
    rng = np.random.default_rng(1)
    polys = polygons(spark, {f"p{i}": [wavy(3000 * i, 0, 900, 640, 12, .2, i)] for i in range(5)} | {f"s{i}": [box(700 * i, 3000, 50)] for i in range(9)})
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-1500, -1500], [14000, 4000], (6000, 2)))]
    frame = spark.createDataFrame(points, "id int, x double, y double")
    outside = frame.join(spatial.points_in_polygons(frame, polys).select("id"), "id", "left_anti")
    pairs = spatial.outline_pairs(polys, outside, "area_code", "id")
    assert pairs.count() <= 50 * 14
    near = {r.area_code: r.distance for r in spatial.nearest_points(polys, outside, "area_code", "id", none_inside=True).collect()}
    for r in polys.select("area_code", "edges").collect():
        a = np.array([(e.x1, e.y1, e.x2, e.y2) for e in r.edges])
        p = np.array([(x, y) for _, x, y in (tuple(q) for q in outside.collect())])
        d = a[:, 2:] - a[:, :2]
        t = np.clip(((p[:, None] - a[None, :, :2]) * d).sum(2) / (d * d).sum(1), 0, 1)
        best = np.sqrt((((p[:, None] - a[None, :, :2]) - t[..., None] * d) ** 2).sum(2)).min()
        assert near[r.area_code] == pytest.approx(best, abs=1e-8)


def test_ring_starts_and_chunks(spark):
    polys = polygons(spark, SHAPES | LARGE_SHAPES)
    starts = bands.ring_starts(polys.select("area_code", "edges"), "edges").groupBy("area_code").count()
    assert {r.area_code: r["count"] for r in starts.collect()} == {n: len(r) for n, r in (SHAPES | LARGE_SHAPES).items()}
    back = bands.chunks(polys).groupBy("area_code").agg(
        F.sum(F.size("edges")).alias("n"), F.max(F.size("edges")).alias("most"), F.min("xmin").alias("x"), F.max("ymax").alias("y")
    )
    for r in back.join(polys, "area_code").collect():
        assert (r.n, r.x, r.y) == (len(r.edges), r.xmin, r.ymax) and r.most <= bands.LARGE
    assert G.EDGES_TYPE
