"""Geometry and nearest neighbours against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaindex.functions import geometry as G
from areaindex.functions.projection import AIRY, airy_to_grid, grid_to_airy, project
from areaindex.operators import knn, spatial


def ring(*pts, hole=False):
    return {"is_hole": hole, "pts": [{"x": float(x), "y": float(y)} for x, y in pts]}


def box(x, y, w, h=None, hole=False):
    h = w if h is None else h
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), hole=hole)


def polygons(spark, shapes, key="area_code"):
    rows = [(name, rings) for name, rings in shapes.items()]
    return spatial.polygons_from_rings(spark.createDataFrame(rows, f"{key} string, rings {G.RINGS_TYPE}"))


SHAPES = {
    "square": [box(0, 0, 4)],
    "holed": [box(10, 0, 4), box(11, 1, 2, hole=True)],
    "parts": [box(20, 0, 2), box(30, 0, 1)],
    "concave": [ring((0, 10), (4, 10), (4, 14), (2, 11), (0, 14))],
    "closed": [ring((10, 10), (10, 12), (12, 12), (12, 10), (10, 10))],  # clockwise and closed
    "beside": [box(4, 1, 2)],
    "far": [box(100, 100, 1)],
    "inner": [box(11.5, 1.5, 1)],
}


def test_measures(spark):
    got = {r["area_code"]: (r["area"], r["cx"], r["cy"]) for r in spatial.polygon_measures(polygons(spark, SHAPES)).collect()}
    assert got["square"] == (16.0, 2.0, 2.0)
    assert got["holed"] == (12.0, 12.0, 2.0)
    assert got["parts"][0] == 5.0 and got["parts"][1] == pytest.approx((4 * 21 + 30.5) / 5)
    assert got["concave"][0] == pytest.approx(10.0)
    assert got["closed"] == (4.0, 11.0, 11.0)


def test_points_in_polygons(spark):
    pts = {"in": (1.1, 1.2), "in hole": (12.1, 2.05), "beside hole": (10.5, 2.0), "second part": (30.5, .5),
           "notch": (2.0, 12.5), "arm": (.3, 13.0), "out": (50, 50), "far": (100.5, 100.25)}
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "id string, x double, y double")
    got = sorted((r["id"], r["area_code"]) for r in spatial.points_in_polygons(points, polygons(spark, SHAPES)).collect())
    assert got == sorted([("in", "square"), ("in hole", "inner"), ("beside hole", "holed"), ("second part", "parts"),
                          ("arm", "concave"), ("far", "far")])


def test_a_vertex_ray_counts_once(spark):
    diamond = polygons(spark, {"d": [ring((0, -2), (2, 0), (0, 2), (-2, 0))]})
    points = spark.createDataFrame([("c", 0.0, 0.0), ("left", -3.0, 0.0), ("right", 3.0, 0.0)], "id string, x double, y double")
    assert [r["id"] for r in spatial.points_in_polygons(points, diamond).collect()] == ["c"]


def test_neighbours_and_touching(spark):
    got = sorted((r["area_code"], r["neighbour"]) for r in spatial.neighbours(polygons(spark, SHAPES)).collect())
    # A polygon inside a hole shares no point with the one around it.
    assert got == [("beside", "square"), ("square", "beside")]
    crossing = {"a": [box(0, 2, 10, 1)], "b": [box(4, 0, 1, 9)], "corner": [box(10, 3, 2)], "within": [box(1, 2.2, .5)]}
    got = {(r["area_code"], r["neighbour"]) for r in spatial.neighbours(polygons(spark, crossing)).collect()}
    assert got == {("a", "b"), ("b", "a"), ("a", "corner"), ("corner", "a"), ("a", "within"), ("within", "a")}


def test_overlap_area(spark):
    shapes = polygons(spark, SHAPES)
    own = {r["a_id"]: r["overlap"] for r in spatial.overlap_area(shapes, shapes).where("a_id = b_id").collect()}
    areas = {r["area_code"]: r["area"] for r in spatial.polygon_measures(shapes).collect()}
    assert own == pytest.approx(areas)
    other = polygons(spark, {
        "half": [box(2, 2, 4)], "tri": [ring((0, 0), (4, 0), (0, 4))], "over hole": [box(10, 0, 2, 4)],
        "band": [box(0, 11.5, 4, 1)],
    }, "id")
    got = {(r["a_id"], r["b_id"]): r["overlap"] for r in spatial.overlap_area(shapes, other, "area_code", "id").collect()}
    assert got[("square", "half")] == pytest.approx(4.0)
    assert got[("square", "tri")] == pytest.approx(8.0)
    assert got[("holed", "over hole")] == pytest.approx(6.0)
    # Between y = 11.5 and 12.5 the notch is 2 * (y - 11) * 2 / 3 wide, 4 / 3 on average.
    assert got[("concave", "band")] == pytest.approx(4 - 4 / 3)
    assert got[("beside", "half")] == pytest.approx(2.0)


def test_overlap_is_symmetric_for_random_triangles(spark):
    rng = np.random.default_rng(3)
    shapes = {f"t{i}": [ring(*rng.random((3, 2)) * 10)] for i in range(14)}
    polys = polygons(spark, shapes)
    got = {(r["a_id"], r["b_id"]): r["overlap"] for r in spatial.overlap_area(polys, polys).collect()}
    for (a, b), v in got.items():
        assert got[(b, a)] == pytest.approx(v, abs=1e-9)

    def inside(tri, p):
        t = [np.array([q["x"], q["y"]]) for q in tri[0]["pts"]]
        side = lambda u, v: u[0] * v[1] - u[1] * v[0]
        s = [side(t[(i + 1) % 3] - t[i], p - t[i]) for i in range(3)]
        return all(v > 0 for v in s) or all(v < 0 for v in s)

    grid = [np.array([x + .05, y + .05]) for x in np.arange(0, 10, .1) for y in np.arange(0, 10, .1)]
    for a, b in (("t0", "t1"), ("t2", "t3"), ("t4", "t5")):
        seen = sum(inside(shapes[a], p) and inside(shapes[b], p) for p in grid) * .01
        assert got.get((a, b), 0.0) == pytest.approx(seen, abs=0.6)


def test_coverage_counts_overlapping_cover_twice(spark):
    areas = polygons(spark, {"a": [box(0, 0, 10)], "bare": [box(50, 50, 10)]})
    cover = polygons(spark, {"g1": [box(-5, -5, 20)], "g2": [box(0, 0, 5, 10)]}, "id")
    got = {r["area_code"]: r["coverage_pct"] for r in spatial.coverage_pct(areas, cover).collect()}
    assert got == {"a": pytest.approx(150.0), "bare": 0.0}


def test_mean_in_or_nearest_with_ties_and_years(spark):
    areas = polygons(spark, {"a": [box(0, 0, 2)], "b": [box(10, 0, 2)], "c": [box(20, 0, 2)]})
    rows = [(1, 1.0, 1.0, 5.0, "x"), (2, 1.5, 1.0, 7.0, "x"), (3, 9.0, 1.0, 1.0, "x"), (4, 13.0, 1.0, 3.0, "x"),
            (5, 19.5, 1.0, 11.0, "x"), (6, 11.0, 1.0, 100.0, "y")]
    points = spark.createDataFrame(rows, "id int, x double, y double, v double, year string")
    once = {r["area_code"]: (r["v"], r["points"]) for r in spatial.mean_in_or_nearest(points.where("year = 'x'"), areas, "v").collect()}
    assert once == {"a": (6.0, 2), "b": (2.0, 0), "c": (11.0, 0)}
    by = {(r["area_code"], r["year"]): r["v"] for r in spatial.mean_in_or_nearest(points, areas, "v", by="year").collect()}
    assert by == {("a", "x"): 6.0, ("b", "x"): 2.0, ("c", "x"): 11.0, ("a", "y"): 100.0, ("b", "y"): 100.0, ("c", "y"): 100.0}


def test_assign_parent_rules(spark):
    parents = polygons(spark, {"p1": [box(0, 0, 10)], "p2": [box(10, 0, 10)]}, "parent_code")
    children = polygons(spark, {
        "inside": [box(1, 1, 2)], "middle": [box(-1, 4, 4)], "edge": [ring((19.5, 1), (30, 0), (30, 2))],
        "away": [box(40, 3, 1)], "two": [box(8, 5, 6, 2)],
    })
    got = {r["area_code"]: (r["parent_code"], r["rule"]) for r in spatial.assign_parent(children, parents).collect()}
    assert got == {"inside": ("p1", "within"), "middle": ("p1", "centroid"), "edge": ("p2", "overlap"),
                   "away": ("p2", "nearest"), "two": ("p2", "centroid")}


def test_locate_postcode(spark):
    places = spark.createDataFrame([("AB1 2CD", 1.0, 1.0), ("ab12cd", .5, 3.0), ("ZZ9 9ZZ", 70.0, 70.0), ("FA1 1FA", 100.5, 100.5)], "postcode string, x double, y double")
    asked = spark.createDataFrame([(1, " ab1 2cd"), (2, "AB12CD"), (3, "zz99zz"), (4, "no1 1ne"), (5, None), (6, "FA11FA")], "id int, postcode string")
    hierarchy = spark.createDataFrame([("square", "Mid")], "area_code string, mid string")
    got = {r.id: (r.area_code, r.mid) for r in spatial.locate_postcode(asked, places, polygons(spark, SHAPES), hierarchy).collect()}
    assert got == {1: ("square", "Mid"), 2: ("square", "Mid"), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("far", None)}


def test_within_distance_and_bounds(spark):
    polys = polygons(spark, SHAPES)
    mask = polygons(spark, {"m": [box(0, 0, 1)]}, "id")
    near = {r["area_code"] for r in spatial.within_distance(polys, mask, 3.5).collect()}
    assert near == {"square", "beside"}
    assert {r["area_code"] for r in spatial.within_distance(polys, mask, 9.5).collect()} >= {"concave", "holed"}
    assert tuple(spatial.bounds(polys).first()) == (0.0, 0.0, 101.0, 101.0)


def brute(points, queries, k):
    found = {}
    for q, x, y in queries:
        order = sorted(points, key=lambda p: (np.hypot(p[1] - x, p[2] - y), p[0]))[:k]
        for r, p in enumerate(order):
            found[(q, r + 1)] = (p[0], np.hypot(p[1] - x, p[2] - y))
    return found


def check_knn(spark, points, queries, k):
    p = spark.createDataFrame(points, "id int, x double, y double")
    q = spark.createDataFrame(queries, "area_code int, x double, y double")
    got = {(r["area_code"], r["rank"]): (r["id"], r["distance"]) for r in knn.knn_join(q, p, k, scale=1.0).collect()}
    want = brute(points, queries, k)
    assert got.keys() == want.keys()
    for key, (i, d) in want.items():
        assert got[key][0] == i and got[key][1] == pytest.approx(d, abs=1e-9), key


def as_rows(a, start=0):
    return [(start + i, float(x), float(y)) for i, (x, y) in enumerate(a)]


def test_knn_uniform_with_ties(spark):
    rng = np.random.default_rng(1)
    check_knn(spark, as_rows(rng.integers(0, 40, (400, 2))), as_rows(rng.random((200, 2)) * 60 - 10), 3)


def test_knn_clusters_and_a_hot_place(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.random((150, 2)) * 1000, 500 + rng.random((150, 2)) * .01, np.full((150, 2), 321.0)])
    queries = np.vstack([rng.random((80, 2)) * 1000, 500 + rng.random((60, 2)) * .01, np.full((60, 2), 321.0),
                         [[-5000, 3], [1e5, 1e5]]])
    check_knn(spark, as_rows(points), as_rows(queries), 4)


def test_knn_on_a_line_and_with_few_points(spark):
    check_knn(spark, as_rows([(0, i * i) for i in range(60)]), as_rows([(5, i * 61.0) for i in range(60)]), 3)
    check_knn(spark, as_rows([(1, 1), (2, 2)]), as_rows([(0, 0), (9, 9)]), 3)
    check_knn(spark, as_rows([(1, 1)]), as_rows([(0, 0), (1, 1)]), 1)


def test_knn_by_year(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y), 2000 + i % 3) for i, (x, y) in enumerate(rng.random((90, 2)) * 100)]
    pts = [p for p in pts if p[3] != 2002 or p[0] < 5]
    queries = as_rows(rng.random((30, 2)) * 100)
    p = spark.createDataFrame(pts, "id int, x double, y double, year int")
    q = spark.createDataFrame(queries, "area_code int, x double, y double")
    got = {(r["year"], r["area_code"], r["rank"]): r["id"] for r in knn.knn_join(q, p, 3, by="year", scale=1.0).collect()}
    want = {}
    for year in (2000, 2001, 2002):
        for (a, r), (i, _) in brute([x[:3] for x in pts if x[3] == year], queries, 3).items():
            want[(year, a, r)] = i
    assert got == want


def test_distance_weighted_skips_missing(spark):
    rows = [("a", 0.9, 10.0, None), ("a", 0.4, 40.0, 7.0), ("b", 1.0, None, None)]
    df = spark.createDataFrame(rows, "k string, distance double, v double, w double")
    got = {r["k"]: (r["v_weighted"], r["w_weighted"]) for r in knn.distance_weighted(df, ["k"], ["v", "w"]).collect()}
    assert got["a"] == (pytest.approx((10 / 1.0 + 40 / 0.5) / (1 + 2)), 7.0) and got["b"] == (None, None)


def test_nearby_entities(spark):
    rows = [("x", "2", 5.0, "IND"), ("x", "1", 9.0, " ind "), ("y", "3", None, "LA"), ("N/A", "4", 1.0, "LA"), (None, "5", 1.0, None),
            ("z", "6", 7.0, None)]
    df = spark.createDataFrame(rows, "name string, urn string, score double, kind string")
    names = lambda only: [(r["name"], r["urn"]) for r in knn.nearby_entities(df, "name", "urn", "score", ["score"], "kind", only).collect()]
    assert names(None) == [("x", "1"), ("z", "6"), ("y", "3")]
    assert names("special") == [("x", "1")] and names("other") == [("z", "6"), ("y", "3")]


def test_projection_example_and_round_trip(spark):
    # The worked example of the Ordnance Survey guide, on the grid's own datum.
    row = spark.range(1).select(
        grid_to_airy(F.lit(651409.903), F.lit(313177.270)).alias("a"),
        airy_to_grid(F.radians(F.lit(52 + 39 / 60 + 27.2531 / 3600)), F.radians(F.lit(1 + 43 / 60 + 4.5177 / 3600))).alias("g"),
    ).first()
    assert np.degrees(row["a"]["lat"]) == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=1e-7)
    assert np.degrees(row["a"]["lon"]) == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=1e-7)
    assert (row["g"]["x"], row["g"]["y"]) == (pytest.approx(651409.903, abs=.01), pytest.approx(313177.270, abs=.01))
    assert AIRY[0] > AIRY[1]
    pts = spark.createDataFrame([(530000.0, 180000.0), (290000.0, 95000.0)], "e double, n double")
    there = project(pts, "e", "n")
    back = project(there, "longitude", "latitude", "latlon", "grid").collect()
    for r in back:
        assert r["easting"] == pytest.approx(r["e"], abs=.5) and r["northing"] == pytest.approx(r["n"], abs=.5)
    london = there.first()
    assert london["latitude"] == pytest.approx(51.50, abs=.01) and london["longitude"] == pytest.approx(-.128, abs=.01)
    with pytest.raises(ValueError):
        project(pts, "e", "n", "grid", "grid")


def test_results_do_not_depend_on_the_join_strategy(spark, monkeypatch):
    from areaindex import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(session, "SMALL_ROWS", -1)
    rng = np.random.default_rng(6)
    check_knn(spark, as_rows(rng.integers(0, 30, (120, 2))), as_rows(rng.random((60, 2)) * 40 - 5), 3)
    test_points_in_polygons(spark)
    test_neighbours_and_touching(spark)


@pytest.mark.parametrize("shape", ["uniform", "dense town"])
def test_knn_compares_few_pairs(spark, shape):
    """Far-off places and a dense cluster do not meet every point."""
    rng = np.random.default_rng(8)
    points = rng.random((4000, 2)) * 1000
    if shape == "dense town":
        points[:3600] = 500 + rng.random((3600, 2)) * 4
    near = rng.random((200, 2)) * 1000
    far = np.concatenate([rng.random((100, 2)) * 1000 + [20_000, 0], rng.random((100, 2)) * 100 - 9_000])
    for places in (near, far):
        p, q = as_rows(points), as_rows(places)
        frame = spark.createDataFrame(p, "id int, x double, y double")
        asked = spark.createDataFrame(q, "area_code int, x double, y double")
        pairs = knn.candidate_pairs(asked, frame, 3)[1].count()
        assert pairs <= 50 * 3 * len(places), (shape, pairs)
    check_knn(spark, as_rows(points[:1500]), as_rows(np.concatenate([near[:40], far[:20], far[-20:]])), 3)
