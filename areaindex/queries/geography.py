"""Polygons, spatial joins and the grid projection.

Every area (customer) owns a cell of 100 by 100 metres, 40 cells a row; every
third area fills it, the others are quadrilaterals with a corner on each side.
Suppliers are larger squares above them, parts are cover rectangles and point
measurements, orders are points.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from areaindex.functions.projection import project
from areaindex.operators import spatial
from areaindex.queries.base import areas, query, rounded, table
from areaindex.queries.services import place
from areaindex.session import checkpointed


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _polygons(df, corners, clockwise):
    """Polygon rows, written once and read from there, as boundaries are."""
    pts = F.array(*[_point(x, y) for x, y in corners])
    ring = F.struct(F.lit(False).alias("is_hole"), F.when(clockwise, F.reverse(pts)).otherwise(pts).alias("pts"))
    return checkpointed(spatial.polygons_from_rings(df.withColumn("rings", F.array(ring))))


def area_polygons(spark, sf):
    k = F.col("area_code")
    x0, y0 = (k % 40) * 100, F.floor(k / 40) * 100
    inset = [F.when(k % 3 != 0, (k * m) % 20).otherwise(0) for m in (7, 11, 13, 17)]
    corners = [
        (x0 + inset[0], y0), (x0 + 100, y0 + inset[1]), (x0 + 100 - inset[2], y0 + 100), (x0, y0 + 100 - inset[3]),
    ]
    keyed = table(spark, sf, "customer").select(F.col("c_custkey").alias("area_code"))
    return _polygons(keyed, corners, k % 2 == 0)


def _box(df, x0, y0, width, height):
    corners = [(x0, y0), (x0 + width, y0), (x0 + width, y0 + height), (x0, y0 + height)]
    return _polygons(df, corners, F.lit(False))


def parent_polygons(spark, sf):
    k = F.col("parent_code")
    keyed = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("parent_code"), "s_nationkey")
    return _box(keyed, (k % 10) * 400 + 110, F.floor(k / 10) * 400 + 110, F.lit(220), F.lit(220))


def _height(spark, sf):
    return table(spark, sf, "customer").agg((F.floor(F.max("c_custkey") / 40) + 1) * 100).scalar()


def cover_polygons(spark, sf):
    k = F.col("id")
    keyed = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).withColumn("h", _height(spark, sf))
    return _box(
        keyed, (k * 7919) % 4001, (k * 104729) % F.col("h"), 20 + (k * 31) % 120, 20 + (k * 37) % 90
    ).drop("h")


def _points(spark, sf, name, key):
    k = F.col("id")
    keyed = table(spark, sf, name).select(F.col(key).alias("id")).withColumn("h", _height(spark, sf))
    return keyed.select(
        "id", ((k * 7919) % 4001 + 0.3719).cast("double").alias("x"),
        ((k * 104729) % F.col("h") + 0.7123).cast("double").alias("y"),
    )


_HEIGHT = "(SELECT (max(c_custkey) // 40 + 1) * 100 FROM customer)"
_POLYS_SQL = """cells AS (
  SELECT c_custkey AS area_code, (c_custkey % 40) * 100 AS x0, (c_custkey // 40) * 100 AS y0,
         CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 7) % 20 ELSE 0 END AS j1,
         CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 11) % 20 ELSE 0 END AS j2,
         CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 13) % 20 ELSE 0 END AS j3,
         CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 17) % 20 ELSE 0 END AS j4 FROM customer),
polys AS (
  SELECT area_code, (x0 + j1)::DOUBLE AS x1, y0::DOUBLE AS y1, (x0 + 100)::DOUBLE AS x2, (y0 + j2)::DOUBLE AS y2,
         (x0 + 100 - j3)::DOUBLE AS x3, (y0 + 100)::DOUBLE AS y3, x0::DOUBLE AS x4, (y0 + 100 - j4)::DOUBLE AS y4,
         x0::DOUBLE AS xmin, y0::DOUBLE AS ymin, (x0 + 100)::DOUBLE AS xmax, (y0 + 100)::DOUBLE AS ymax FROM cells)"""


def _edges_sql(name: str, source: str, key: str) -> str:
    sides = [(1, 2), (2, 3), (3, 4), (4, 1)]
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT {key} AS k, x{a} AS ax, y{a} AS ay, x{b} AS zx, y{b} AS zy FROM {source}" for a, b in sides
    ) + ")"


_PARENTS_SQL = """squares AS (
  SELECT s_suppkey AS parent_code, s_nationkey, ((s_suppkey % 10) * 400 + 110)::DOUBLE AS xmin,
         ((s_suppkey // 10) * 400 + 110)::DOUBLE AS ymin FROM supplier),
parents AS (
  SELECT *, xmin + 220 AS xmax, ymin + 220 AS ymax, xmin AS x1, ymin AS y1, xmin + 220 AS x2, ymin AS y2,
         xmin + 220 AS x3, ymin + 220 AS y3, xmin AS x4, ymin + 220 AS y4 FROM squares)"""


def _points_sql(name: str, key: str, extra: str = "") -> str:
    return f"""pts AS (SELECT {key} AS id{extra}, ({key} * 7919) % 4001 + 0.3719::DOUBLE AS x,
  ({key} * 104729) % {_HEIGHT} + 0.7123::DOUBLE AS y FROM {name})"""


def _inside_sql(p: str = "p", q: str = "q") -> str:
    """Strictly left of all four sides of a counter-clockwise quadrilateral."""
    sides = [(1, 2), (2, 3), (3, 4), (4, 1)]
    return " AND ".join(
        f"({p}.x{b} - {p}.x{a}) * ({q}.y - {p}.y{a}) - ({p}.y{b} - {p}.y{a}) * ({q}.x - {p}.x{a}) > 0" for a, b in sides
    )


_MEASURES_SQL = """measures AS (
  SELECT area_code, sum(c) / 2 AS area, any_value(x0) + sum(sx * c) / (3 * sum(c)) AS cx,
         any_value(y0) + sum(sy * c) / (3 * sum(c)) AS cy
  FROM (SELECT area_code, xmin AS x0, ymin AS y0, (ax - xmin) * (zy - ymin) - (zx - xmin) * (ay - ymin) AS c,
               ax + zx - 2 * xmin AS sx, ay + zy - 2 * ymin AS sy FROM pe JOIN polys ON area_code = k) GROUP BY 1)"""


@query("polygon_measures", f"""WITH {_POLYS_SQL}, {_edges_sql("pe", "polys", "area_code")}, {_MEASURES_SQL}
SELECT area_code, round(area, 6) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM measures""")
def polygon_measures(spark, sf):
    found = spatial.polygon_measures(area_polygons(spark, sf))
    return rounded(found.select("area_code", "area", "cx", "cy"), "area", "cx", "cy")


@query("bounds_by_mid", f"""WITH {_POLYS_SQL}
SELECT c_nationkey AS mid_code, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax
FROM polys JOIN customer ON c_custkey = area_code GROUP BY 1""")
def bounds_by_mid(spark, sf):
    mids = areas(spark, sf).select("area_code", "mid_code")
    return spatial.bounds(area_polygons(spark, sf).join(mids, "area_code"), ["mid_code"])


@query("edge_table", f"""WITH {_POLYS_SQL}, {_edges_sql("pe", "polys", "area_code")}
SELECT k AS area_code, count(*) AS edges, round(sum(sqrt(pow(zx - ax, 2) + pow(zy - ay, 2))), 6) AS outline
FROM pe GROUP BY 1""")
def edge_table(spark, sf):
    edges = spatial.edge_table(area_polygons(spark, sf), "area_code")
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return rounded(
        edges.groupBy("area_code").agg(F.count(F.lit(1)).alias("edges"), F.sum(length).alias("outline")), "outline"
    )


@query("points_in_polygons", f"""WITH {_POLYS_SQL}, {_points_sql("orders", "o_orderkey")}
SELECT q.id, p.area_code FROM pts q JOIN polys p
  ON q.x BETWEEN p.xmin AND p.xmax AND q.y BETWEEN p.ymin AND p.ymax AND {_inside_sql()}""")
def points_in_polygons(spark, sf):
    points = _points(spark, sf, "orders", "o_orderkey")
    return spatial.points_in_polygons(points, area_polygons(spark, sf)).select("id", "area_code")


@query("locate_point", f"""WITH {_POLYS_SQL}, {_points_sql("orders", "o_orderkey")},
hit AS (SELECT q.id, p.area_code FROM pts q JOIN polys p
  ON q.x BETWEEN p.xmin AND p.xmax AND q.y BETWEEN p.ymin AND p.ymax AND {_inside_sql()})
SELECT o_orderkey AS id, area_code, n_name AS mid_name FROM orders LEFT JOIN hit ON id = o_orderkey
LEFT JOIN customer ON c_custkey = area_code LEFT JOIN nation ON n_nationkey = c_nationkey""")
def locate_point(spark, sf):
    hierarchy = areas(spark, sf).select("area_code", "mid_name")
    found = spatial.locate_point(_points(spark, sf, "orders", "o_orderkey"), area_polygons(spark, sf), hierarchy)
    return found.select("id", "area_code", "mid_name")


@query("locate_postcode", f"""WITH {_POLYS_SQL}, {_points_sql("part", "p_partkey")},
hit AS (SELECT q.id, p.area_code FROM pts q JOIN polys p
  ON q.x BETWEEN p.xmin AND p.xmax AND q.y BETWEEN p.ymin AND p.ymax AND {_inside_sql()})
SELECT s_suppkey AS id, 'ex' || (s_suppkey * 3) || '  4qJ ' AS postcode, area_code, n_name AS mid_name
FROM supplier LEFT JOIN hit ON id = s_suppkey * 3
LEFT JOIN customer ON c_custkey = area_code LEFT JOIN nation ON n_nationkey = c_nationkey""")
def locate_postcode(spark, sf):
    """Suppliers ask, in careless spelling, where the postcode of a part lies; some postcodes are unknown."""
    code = F.concat(F.lit("EX"), F.col("id").cast("string"), F.lit(" 4QJ"))
    places = _points(spark, sf, "part", "p_partkey").withColumn("postcode", code).drop("id")
    key = F.col("s_suppkey")
    asked = table(spark, sf, "supplier").select(
        key.alias("id"), F.concat(F.lit("ex"), (key * 3).cast("string"), F.lit("  4qJ ")).alias("postcode")
    )
    hierarchy = areas(spark, sf).select("area_code", "mid_name")
    found = spatial.locate_postcode(asked, places, area_polygons(spark, sf), hierarchy)
    return found.select("id", "postcode", "area_code", "mid_name")


def _gap_sql(px: str, py: str, e: str = "e") -> str:
    t = (
        f"greatest(0, least(1, (({px} - {e}.ax) * ({e}.zx - {e}.ax) + ({py} - {e}.ay) * ({e}.zy - {e}.ay)) "
        f"/ (pow({e}.zx - {e}.ax, 2) + pow({e}.zy - {e}.ay, 2))))"
    )
    return f"sqrt(pow({px} - {e}.ax - {t} * ({e}.zx - {e}.ax), 2) + pow({py} - {e}.ay - {t} * ({e}.zy - {e}.ay), 2))"


@query("mean_in_or_nearest", f"""WITH {_POLYS_SQL}, {_edges_sql("pe", "polys", "area_code")},
{_points_sql("part", "p_partkey", ", p_retailprice AS v")},
ins AS (SELECT p.area_code, avg(v) AS v, count(*) AS points FROM pts q JOIN polys p
  ON q.x BETWEEN p.xmin AND p.xmax AND q.y BETWEEN p.ymin AND p.ymax AND {_inside_sql()} GROUP BY 1),
away AS (SELECT e.k AS area_code, q.id, any_value(q.v) AS v, round(min({_gap_sql("q.x", "q.y")}), 9) AS d
  FROM pe e, pts q WHERE e.k NOT IN (SELECT area_code FROM ins) GROUP BY 1, 2),
near AS (SELECT area_code, avg(v) AS v, 0 AS points FROM (
  SELECT *, rank() OVER (PARTITION BY area_code ORDER BY d) AS r FROM away) WHERE r = 1 GROUP BY 1)
SELECT area_code, round(v, 6) AS v, points FROM (SELECT * FROM ins UNION ALL SELECT * FROM near)""")
def mean_in_or_nearest(spark, sf):
    value = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    points = _points(spark, sf, "part", "p_partkey").join(value, "id")
    return rounded(spatial.mean_in_or_nearest(points, area_polygons(spark, sf), "v"), "v")


def _apart_sql(strict: bool) -> str:
    """A side of one polygon with all corners of the other beyond it."""
    op = "<" if strict else "<="

    def beyond(e: str, corners: str) -> str:
        return " AND ".join(
            f"({e}.zx - {e}.ax) * ({corners}.y{i} - {e}.ay) - ({e}.zy - {e}.ay) * ({corners}.x{i} - {e}.ax) {op} 0"
            for i in (1, 2, 3, 4)
        )

    return f"""apart AS (
  SELECT a, b FROM cand JOIN ea e ON e.k = a JOIN pb c ON c.k = b WHERE {beyond("e", "c")}
  UNION SELECT a, b FROM cand JOIN eb e ON e.k = b JOIN pa c ON c.k = a WHERE {beyond("e", "c")})"""


def _cand_sql() -> str:
    return """cand AS (SELECT pa.k AS a, pb.k AS b FROM pa JOIN pb ON pa.xmin <= pb.xmax AND pb.xmin <= pa.xmax
  AND pa.ymin <= pb.ymax AND pb.ymin <= pa.ymax)"""


def _pairs_sql(first: str, first_key: str, second: str, second_key: str, strict: bool) -> str:
    return f"""pa AS (SELECT {first_key} AS k, * FROM {first}), pb AS (SELECT {second_key} AS k, * FROM {second}),
{_edges_sql("ea", first, first_key)}, {_edges_sql("eb", second, second_key)}, {_cand_sql()}, {_apart_sql(strict)},
met AS (SELECT a, b FROM cand ANTI JOIN apart USING (a, b))"""


@query("neighbours", f"""WITH {_POLYS_SQL}, {_pairs_sql("polys", "area_code", "polys", "area_code", True)}
SELECT a AS area_code, b AS neighbour FROM met WHERE a <> b""")
def neighbours(spark, sf):
    return spatial.neighbours(area_polygons(spark, sf))


@query("intersecting_pairs", f"""WITH {_POLYS_SQL}, {_PARENTS_SQL},
{_pairs_sql("polys", "area_code", "parents", "parent_code", True)} SELECT a AS a_id, b AS b_id FROM met""")
def intersecting_pairs(spark, sf):
    return spatial.intersecting(area_polygons(spark, sf), parent_polygons(spark, sf), "area_code", "parent_code")


# The common area as the signed sum of trapezoids under the lower of two sides.
_OVERLAP_SQL = """ov AS (SELECT a, b, sum(CASE WHEN r > l THEN s * (r - l) *
    ((hl + hr + gl + gr) / 2 - (CASE WHEN (hl - gl) * (hr - gr) >= 0 THEN abs(hl - gl) + abs(hr - gr)
      ELSE (pow(hl - gl, 2) + pow(hr - gr, 2)) / (abs(hl - gl) + abs(hr - gr)) END) / 2) / 2 ELSE 0 END) AS overlap
  FROM (SELECT *, eay + (l - eax) * (eby - eay) / (ebx - eax) AS hl, eay + (r - eax) * (eby - eay) / (ebx - eax) AS hr,
               fay + (l - fax) * (fby - fay) / (fbx - fax) AS gl, fay + (r - fax) * (fby - fay) / (fbx - fax) AS gr
        FROM (SELECT a, b, e.ax AS eax, e.ay AS eay, e.zx AS ebx, e.zy AS eby, f.ax AS fax, f.ay AS fay, f.zx AS fbx, f.zy AS fby,
                     greatest(least(e.ax, e.zx), least(f.ax, f.zx)) AS l, least(greatest(e.ax, e.zx), greatest(f.ax, f.zx)) AS r,
                     CASE WHEN (e.ax > e.zx) = (f.ax > f.zx) THEN 1 ELSE -1 END AS s
              FROM cand JOIN ea e ON e.k = a JOIN eb f ON f.k = b WHERE e.ax <> e.zx AND f.ax <> f.zx)) GROUP BY 1, 2)"""


@query("overlap_area", f"""WITH {_POLYS_SQL}, {_PARENTS_SQL},
{_pairs_sql("polys", "area_code", "parents", "parent_code", False)}, {_OVERLAP_SQL}
SELECT a AS a_id, b AS b_id, round(overlap, 4) AS overlap FROM ov WHERE round(overlap, 4) > 0""")
def overlap_area(spark, sf):
    found = spatial.overlap_area(area_polygons(spark, sf), parent_polygons(spark, sf), "area_code", "parent_code")
    return rounded(found, "overlap", digits=4).where("overlap > 0")


@query("restrict_to_mask", f"""WITH {_POLYS_SQL}, {_PARENTS_SQL}, mask AS (SELECT * FROM parents WHERE s_nationkey = 4),
{_pairs_sql("polys", "area_code", "mask", "parent_code", True)}, {_OVERLAP_SQL}
SELECT a AS area_code, round(coalesce(sum(overlap), 0), 4) AS area_within FROM met LEFT JOIN ov USING (a, b) GROUP BY 1""")
def restrict_to_mask(spark, sf):
    mask = parent_polygons(spark, sf).where("s_nationkey = 4")
    found = spatial.restrict_to(area_polygons(spark, sf), mask, "area_code", "parent_code")
    return rounded(found.select("area_code", "area_within"), "area_within", digits=4)


@query("coverage_pct", f"""WITH plots AS (
  SELECT c_custkey AS area_code, (c_custkey % 40) * 100 AS x0, (c_custkey // 40) * 100 AS y0 FROM customer),
cover AS (SELECT (p_partkey * 7919) % 4001 AS u, (p_partkey * 104729) % {_HEIGHT} AS v, 20 + (p_partkey * 31) % 120 AS w,
                 20 + (p_partkey * 37) % 90 AS h FROM part)
SELECT area_code, round(coalesce(sum((least(x0 + 100, u + w) - greatest(x0, u)) * (least(y0 + 100, v + h) - greatest(y0, v)))
  FILTER (WHERE u IS NOT NULL) / 100.0::DOUBLE, 0), 6) AS coverage_pct
FROM plots LEFT JOIN cover ON u < x0 + 100 AND u + w > x0 AND v < y0 + 100 AND v + h > y0 GROUP BY 1""")
def coverage_pct(spark, sf):
    k = F.col("area_code")
    keyed = table(spark, sf, "customer").select(F.col("c_custkey").alias("area_code"))
    plots = _box(keyed, (k % 40) * 100, F.floor(k / 40) * 100, F.lit(100), F.lit(100))
    return rounded(spatial.coverage_pct(plots, cover_polygons(spark, sf)), "coverage_pct")


_VERTEX_GAP = " UNION ALL ".join(
    f"SELECT c.area_code, p.parent_code, {_gap_sql(f'c.x{i}', f'c.y{i}')} AS d FROM rest c, parents p JOIN eb e ON e.k = p.parent_code "
    f"UNION ALL SELECT c.area_code, p.parent_code, {_gap_sql(f'p.x{i}', f'p.y{i}')} AS d FROM parents p, rest c JOIN ea e ON e.k = c.area_code"
    for i in (1, 2, 3, 4)
)


@query("assign_parent", f"""WITH {_POLYS_SQL}, {_PARENTS_SQL},
{_pairs_sql("polys", "area_code", "parents", "parent_code", False)}, {_edges_sql("pe", "polys", "area_code")}, {_MEASURES_SQL},
known AS (
  SELECT a AS area_code, min(CASE WHEN c.xmin >= p.xmin AND c.xmax <= p.xmax AND c.ymin >= p.ymin AND c.ymax <= p.ymax THEN b END) AS w,
         min(CASE WHEN cx > p.xmin AND cx < p.xmax AND cy > p.ymin AND cy < p.ymax THEN b END) AS m, min(b) AS o
  FROM met JOIN polys c ON c.area_code = a JOIN parents p ON p.parent_code = b JOIN measures USING (area_code) GROUP BY 1),
rest AS (SELECT * FROM polys WHERE area_code NOT IN (SELECT area_code FROM known)),
near AS (SELECT area_code, arg_min(parent_code, (d, parent_code)) AS n FROM (
  SELECT area_code, parent_code, round(min(d), 9) AS d FROM ({_VERTEX_GAP}) GROUP BY 1, 2) GROUP BY 1)
SELECT area_code, coalesce(w, m, o) AS parent_code,
       CASE WHEN w IS NOT NULL THEN 'within' WHEN m IS NOT NULL THEN 'centroid' ELSE 'overlap' END AS rule FROM known
UNION ALL SELECT area_code, n, 'nearest' FROM near""")
def assign_parent(spark, sf):
    return spatial.assign_parent(area_polygons(spark, sf), parent_polygons(spark, sf))


_A, _B, _F0 = 6377563.396, 6356256.909, 0.9996012717
_N = (_A - _B) / (_A + _B)
_E2 = 1 - (_B * _B) / (_A * _A)


def _arc_sql(lat: str) -> str:
    lat0 = "radians(49.0::DOUBLE)"
    n = _N
    return (
        f"{_B * _F0!r} * ({1 + n + 5 / 4 * n ** 2 + 5 / 4 * n ** 3!r} * ({lat} - {lat0}) "
        f"- {3 * n + 3 * n ** 2 + 21 / 8 * n ** 3!r} * sin({lat} - {lat0}) * cos({lat} + {lat0}) "
        f"+ {15 / 8 * n ** 2 + 15 / 8 * n ** 3!r} * sin(2 * ({lat} - {lat0})) * cos(2 * ({lat} + {lat0})) "
        f"- {35 / 24 * n ** 3!r} * sin(3 * ({lat} - {lat0})) * cos(3 * ({lat} + {lat0})))"
    )


_STEPS_SQL = ",\n".join(
    f"f{i} AS (SELECT area_code, e, n, {'radians(49.0::DOUBLE)' if i == 0 else f'lat + (n + 100000 - ({_arc_sql("lat")})) / {_A * _F0!r}'} AS lat "
    f"FROM {'g' if i == 0 else f'f{i - 1}'})" for i in range(7)
)
_G = {"a": 6378137.0, "b": 6356752.314140}
_G["e2"] = 1 - (_G["b"] ** 2) / (_G["a"] ** 2)
_ITER_SQL = ",\n".join(
    f"h{i} AS (SELECT area_code, x2, y2, z2, "
    + ("atan2(z2, sqrt(x2 * x2 + y2 * y2) * (1 - {e2!r})) AS lat" if i == 0 else
       "atan2(z2 + {e2!r} * {a!r} / sqrt(1 - {e2!r} * pow(sin(lat), 2)) * sin(lat), sqrt(x2 * x2 + y2 * y2)) AS lat").format(**_G)
    + f" FROM {'turned' if i == 0 else f'h{i - 1}'})" for i in range(7)
)


@query("project_grid_to_latlon", f"""WITH g AS (
  SELECT c_custkey AS area_code, 300000.0::DOUBLE + (c_custkey * 7919) % 10007 AS e, 100000.0::DOUBLE + (c_custkey * 104729) % 10009 AS n
  FROM customer), {_STEPS_SQL},
c AS (SELECT *, e - 400000 AS d, tan(lat) AS t, 1 / cos(lat) AS sec, {_A * _F0!r} / sqrt(1 - {_E2!r} * pow(sin(lat), 2)) AS nu,
        {_A * _F0 * (1 - _E2)!r} / pow(1 - {_E2!r} * pow(sin(lat), 2), 1.5) AS rho FROM f6),
airy AS (SELECT area_code,
  lat - t / (2 * rho * nu) * pow(d, 2) + t / (24 * rho * pow(nu, 3)) * (5 + 3 * t * t + (nu / rho - 1) - 9 * t * t * (nu / rho - 1)) * pow(d, 4)
    - t / (720 * rho * pow(nu, 5)) * (61 + 90 * t * t + 45 * pow(t, 4)) * pow(d, 6) AS lat,
  radians(-2.0::DOUBLE) + sec / nu * d - sec / (6 * pow(nu, 3)) * (nu / rho + 2 * t * t) * pow(d, 3)
    + sec / (120 * pow(nu, 5)) * (5 + 28 * t * t + 24 * pow(t, 4)) * pow(d, 5)
    - sec / (5040 * pow(nu, 7)) * (61 + 662 * t * t + 1320 * pow(t, 4) + 720 * pow(t, 6)) * pow(d, 7) AS lon FROM c),
xyz AS (SELECT area_code, {_A!r} / sqrt(1 - {_E2!r} * pow(sin(lat), 2)) * cos(lat) * cos(lon) AS x,
  {_A!r} / sqrt(1 - {_E2!r} * pow(sin(lat), 2)) * cos(lat) * sin(lon) AS y,
  {_A * (1 - _E2)!r} / sqrt(1 - {_E2!r} * pow(sin(lat), 2)) * sin(lat) AS z FROM airy),
turned AS (SELECT area_code, 446.448 + x * (1 - 20.4894e-6) - radians(0.8421 / 3600) * y + radians(0.2470 / 3600) * z AS x2,
  -125.157 + radians(0.8421 / 3600) * x + y * (1 - 20.4894e-6) - radians(0.1502 / 3600) * z AS y2,
  542.060 - radians(0.2470 / 3600) * x + radians(0.1502 / 3600) * y + z * (1 - 20.4894e-6) AS z2 FROM xyz),
{_ITER_SQL}
SELECT area_code, round(degrees(lat), 7) AS latitude, round(degrees(atan2(y2, x2)), 7) AS longitude FROM h6""")
def project_grid_to_latlon(spark, sf):
    keyed = table(spark, sf, "customer").select(F.col("c_custkey").alias("area_code"))
    x, y = place("area_code")
    points = keyed.select("area_code", (x + 300000).alias("e"), (y + 100000).alias("n"))
    return rounded(project(points, "e", "n").select("area_code", "latitude", "longitude"), "latitude", "longitude", digits=7)
