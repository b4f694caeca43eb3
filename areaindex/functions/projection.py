"""British National Grid to latitude and longitude, as column expressions.

Redfearn's transverse Mercator series and the seven-parameter datum shift, as
published by the Ordnance Survey ("A guide to coordinate systems in Great
Britain"). Good to a few metres; no grid-shift file is involved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.geometry import let

# Semi-axes of the Airy 1830 and GRS80 ellipsoids (metres).
AIRY = (6377563.396, 6356256.909)
GRS80 = (6378137.0, 6356752.314140)

# The National Grid projection.
SCALE = 0.9996012717
LAT0 = math.radians(49.0)
LON0 = math.radians(-2.0)
EAST0 = 400000.0
NORTH0 = -100000.0

# Shift from WGS84 to the National Grid datum (metres, ppm, arc seconds).
TO_GRID = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)


def _sq(ellipsoid: tuple[float, float]) -> float:
    a, b = ellipsoid
    return 1 - (b * b) / (a * a)


def _arc(lat: Column) -> Column:
    """Developed meridional arc from the true origin."""
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return F.lit(b * SCALE) * (
        d * (1 + n + 5 / 4 * n ** 2 + 5 / 4 * n ** 3)
        - F.sin(d) * F.cos(s) * (3 * n + 3 * n ** 2 + 21 / 8 * n ** 3)
        + F.sin(d * 2) * F.cos(s * 2) * (15 / 8 * n ** 2 + 15 / 8 * n ** 3)
        - F.sin(d * 3) * F.cos(s * 3) * (35 / 24 * n ** 3)
    )


def _curvature(lat: Column) -> Column:
    """struct<nu, rho, eta2> at a latitude."""
    e2 = _sq(AIRY)
    w = 1 - F.sin(lat) ** 2 * e2
    nu = F.lit(AIRY[0] * SCALE) / F.sqrt(w)
    rho = F.lit(AIRY[0] * SCALE * (1 - e2)) / (w * F.sqrt(w))
    return F.struct(nu.alias("nu"), rho.alias("rho"), (nu / rho - 1).alias("eta2"))


def grid_to_airy(east: Column, north: Column) -> Column:
    """struct<lat, lon> in radians on the grid's own datum."""
    height = north - NORTH0
    steps = F.sequence(F.lit(1), F.lit(6))
    foot = F.aggregate(
        steps, F.lit(LAT0), lambda lat, _: lat + (height - _arc(lat)) / (AIRY[0] * SCALE)
    )

    def at(p: Column) -> Column:
        lat, c = p["lat"], p["c"]
        nu, rho, eta2 = c["nu"], c["rho"], c["eta2"]
        t = F.tan(lat)
        t2 = t * t
        sec = 1 / F.cos(lat)
        d = east - EAST0
        vii = t / (2 * rho * nu)
        viii = t / (24 * rho * nu ** 3) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2)
        ix = t / (720 * rho * nu ** 5) * (61 + 90 * t2 + 45 * t2 * t2)
        x = sec / nu
        xi = sec / (6 * nu ** 3) * (nu / rho + 2 * t2)
        xii = sec / (120 * nu ** 5) * (5 + 28 * t2 + 24 * t2 * t2)
        xiia = sec / (5040 * nu ** 7) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2)
        return F.struct(
            (lat - vii * d ** 2 + viii * d ** 4 - ix * d ** 6).alias("lat"),
            (F.lit(LON0) + x * d - xi * d ** 3 + xii * d ** 5 - xiia * d ** 7).alias("lon"),
        )

    return let(foot, lambda lat: let(F.struct(lat.alias("lat"), _curvature(lat).alias("c")), at))


def airy_to_grid(lat: Column, lon: Column) -> Column:
    """struct<x, y> in metres from latitude and longitude (radians) on the grid's datum."""
    def at(p: Column) -> Column:
        lat, d, c = p["lat"], p["d"], p["c"]
        nu, rho, eta2 = c["nu"], c["rho"], c["eta2"]
        s, k = F.sin(lat), F.cos(lat)
        t2 = F.tan(lat) ** 2
        ii = nu / 2 * s * k
        iii = nu / 24 * s * k ** 3 * (5 - t2 + 9 * eta2)
        iiia = nu / 720 * s * k ** 5 * (61 - 58 * t2 + t2 * t2)
        v = nu / 6 * k ** 3 * (nu / rho - t2)
        vi = nu / 120 * k ** 5 * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2)
        return F.struct(
            (F.lit(EAST0) + nu * k * d + v * d ** 3 + vi * d ** 5).alias("x"),
            (_arc(lat) + NORTH0 + ii * d ** 2 + iii * d ** 4 + iiia * d ** 6).alias("y"),
        )

    return let(F.struct(lat.alias("lat"), (lon - LON0).alias("d"), _curvature(lat).alias("c")), at)


def _shift(lat: Column, lon: Column, source, target, parameters) -> Column:
    """struct<lat, lon> moved from one datum to another, height taken as zero."""
    tx, ty, tz, ppm, rx, ry, rz = parameters
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    m = 1 + ppm * 1e-6
    e2, e2t = _sq(source), _sq(target)

    def cartesian(p: Column) -> Column:
        nu = F.lit(source[0]) / F.sqrt(1 - F.sin(p["lat"]) ** 2 * e2)
        return F.struct(
            (nu * F.cos(p["lat"]) * F.cos(p["lon"])).alias("x"),
            (nu * F.cos(p["lat"]) * F.sin(p["lon"])).alias("y"),
            (nu * (1 - e2) * F.sin(p["lat"])).alias("z"),
        )

    def turned(c: Column) -> Column:
        return F.struct(
            (c["x"] * m - c["y"] * rz + c["z"] * ry + tx).alias("x"),
            (c["x"] * rz + c["y"] * m - c["z"] * rx + ty).alias("y"),
            (-c["x"] * ry + c["y"] * rx + c["z"] * m + tz).alias("z"),
        )

    def angles(c: Column) -> Column:
        flat = F.sqrt(c["x"] ** 2 + c["y"] ** 2)

        def step(lat: Column, _: Column) -> Column:
            nu = F.lit(target[0]) / F.sqrt(1 - F.sin(lat) ** 2 * e2t)
            return F.atan2(c["z"] + nu * F.sin(lat) * e2t, flat)

        start = F.atan2(c["z"], flat * (1 - e2t))
        lat2 = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step)
        return F.struct(lat2.alias("lat"), F.atan2(c["y"], c["x"]).alias("lon"))

    point = F.struct(lat.alias("lat"), lon.alias("lon"))
    return let(point, lambda p: let(cartesian(p), lambda c: let(turned(c), angles)))


def to_grid(lon: Column, lat: Column) -> Column:
    """struct<x, y> in metres from longitude and latitude in degrees."""
    moved = _shift(F.radians(lat), F.radians(lon), GRS80, AIRY, TO_GRID)
    return let(moved, lambda p: airy_to_grid(p["lat"], p["lon"]))


def rings_to_grid(rings: Column) -> Column:
    """Rings in degrees (x is the longitude) to rings in metres."""
    return F.transform(rings, lambda r: F.struct(
        r["is_hole"].alias("is_hole"),
        F.transform(r["pts"], lambda p: to_grid(p["x"], p["y"])).alias("pts"),
    ))


def project(df: DataFrame, x: str, y: str, src: str = "grid", dst: str = "latlon") -> DataFrame:
    """Add latitude/longitude in degrees (``latlon``), or x/y in metres (``grid``).

    From ``grid``, ``x`` and ``y`` are easting and northing; from ``latlon``
    they are longitude and latitude in degrees.
    """
    if (src, dst) == ("grid", "latlon"):
        back = tuple(-v for v in TO_GRID)
        airy = grid_to_airy(F.col(x).cast("double"), F.col(y).cast("double"))
        moved = let(airy, lambda p: _shift(p["lat"], p["lon"], AIRY, GRS80, back))
        return df.withColumn("__g", moved).withColumns({
            "latitude": F.degrees("__g.lat"), "longitude": F.degrees("__g.lon"),
        }).drop("__g")
    if (src, dst) == ("latlon", "grid"):
        return df.withColumn("__g", to_grid(F.col(x), F.col(y))).withColumns({
            "easting": F.col("__g.x"), "northing": F.col("__g.y"),
        }).drop("__g")
    raise ValueError(f"no transformation from {src} to {dst}")
