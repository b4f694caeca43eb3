"""Queries over files: tables are written in the layouts that sources come in, read back and compared."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import functions as F

from areaindex.functions import clean
from areaindex.operators import robustness, spatial
from areaindex.queries.base import query, rounded, table
from areaindex.queries.index import _ALTERNATIVES_SQL, _RANKED_SQL, _alternatives, _shift_sql
from areaindex.session import ensure_checkpoint_dir
from areaindex.sources import polygons, tables


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("csv_projected", "SELECT c_custkey, c_acctbal FROM customer")
def csv_projected(spark, sf):
    path = _folder(spark, "csv")
    tables.write_table(_customers(spark, sf), path, fmt="csv")
    read = tables.read_csv_projected(spark, path, ["c_custkey", "c_acctbal"])
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("csv_drifting_headers", """
SELECT c_custkey AS area_code, c_acctbal AS balance FROM customer WHERE c_nationkey % 3 <> 2""")
def csv_drifting_headers(spark, sf):
    """Three layouts: two with other names for the same columns, one without the value, which is passed over."""
    path, whole = _folder(spark, "drift"), _customers(spark, sf)
    layouts = {0: ("Area Code", "Balance 2019"), 1: ("AREA CODE ", "balance_2020"), 2: ("area code", "other")}
    for kind, (code, value) in layouts.items():
        part = whole.where(F.col("c_nationkey") % 3 == kind).select(F.col("c_custkey").alias(code), F.col("c_acctbal").alias(value))
        tables.write_table(part, f"{path}/{kind}", fmt="csv")
    import re

    names = {"area_code": ["lsoa code", "area code"], "balance": [re.compile(r"balance[ _]\d{4}")]}
    read = tables.read_csv_drifting(spark, path, names, ["area_code", "balance"])
    return read.select(F.col("area_code").cast("long").alias("area_code"), F.col("balance").cast("double").alias("balance"))


@query("csv_headerless_latin", """
SELECT c_custkey AS area_code, 'Élan ' || c_name AS name, CAST(round(c_acctbal * 1000) AS DOUBLE) AS amount FROM customer""")
def csv_headerless_latin(spark, sf):
    """Columns by position, another encoding, and numbers with thousands separators."""
    path = _folder(spark, "latin")
    _customers(spark, sf).select(
        "c_custkey", F.concat(F.lit("Élan "), "c_name"), F.lit("not read"), F.format_number(F.round(F.col("c_acctbal") * 1000), 0)
    ).write.option("encoding", "ISO-8859-1").option("header", False).csv(path)
    read = tables.read_csv_headerless(
        spark, path, ["area_code", "name", "note", "amount"], ["area_code", "name", "amount"], encoding="ISO-8859-1"
    )
    return read.select(
        F.col("area_code").cast("long").alias("area_code"), "name", clean.to_number("amount").cast("double").alias("amount")
    )


@query("file_name_keys", r"""
SELECT page_id, CAST(regexp_extract(url, '/(\d+)', 1) AS INT) AS number FROM pages
WHERE regexp_matches(url, '/(\d+)') AND NOT contains(lower(url), 'example.net')""")
def file_name_keys(spark, sf):
    """Keys found in names of files; some names are left out."""
    named = table(spark, sf, "pages").select("page_id", F.col("url").alias(tables.SOURCE_FILE))
    kept = tables.exclude_files(named, "Example.NET")
    return tables.key_from_filename(kept, r"/(\d+)", "number").select("page_id", "number")


@query("sliced_write", """
SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS orders, true AS slices_in_order FROM orders""")
def sliced_write(spark, sf):
    """Contiguous sorted slices: no two files overlap in the key they are sliced by."""
    path = _folder(spark, "slices")
    tables.write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, files=6, order=["o_orderkey"])
    read = spark.read.parquet(path).select("o_orderkey", F.col("_metadata.file_name").alias("file"))
    ends = read.groupBy("file").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    slices = ends.agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    after = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i - 1)["hi"] < F.get("s", i)["lo"])
    return slices.select(
        "rows", read.agg(F.count_distinct("o_orderkey")).scalar().alias("orders"),
        F.forall(after, lambda ok: ok).alias("slices_in_order"),
    )


@query("source_attributions", """
SELECT 's' || s_suppkey AS id, s_name AS name, 'Held by ' || s_name || ' 2024, ' || n_name || ' 2024.' AS attribution,
       '- **[' || s_name || '](https://example.org/' || s_suppkey || '):** Held by ' || s_name || ' 2024, ' || n_name || ' 2024.' AS line
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def source_attributions(spark, sf):
    """Registry of sources, listed with the year in what they ask to be said of them."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    registry = table(spark, sf, "supplier").join(nation, "s_nationkey").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.format_string("Held by %s {year}, %s {year}.", "s_name", "n_name").alias("attribution"),
        F.format_string("https://example.org/%d", "s_suppkey").alias("url"),
    )
    return tables.attribution_list(registry, 2024).select("id", "name", "attribution", "line")


_SIDE, _X0, _Y0 = "(10 + c_custkey % 7)", "(c_custkey % 40 * 100)", "(c_custkey // 40 * 100)"
_SQUARES_SQL = f"""
SELECT c_custkey AS area_code, CAST({_SIDE} * {_SIDE} AS DOUBLE) AS area,
       CAST({_X0} + {_SIDE} / 2.0 AS DOUBLE) AS cx, CAST({_Y0} + {_SIDE} / 2.0 AS DOUBLE) AS cy FROM customer"""


def _squares(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("area_code"), (10 + key % 7).alias("side"), (key % 40 * 100).alias("x"), (F.floor(key / 40) * 100).alias("y")
    )


def _measured(polys):
    found = spatial.polygon_measures(polys).select(F.col("area_code").cast("long").alias("area_code"), "area", "cx", "cy")
    return rounded(found, "area", "cx", "cy")


def _square_features(spark, sf):
    """Each square as the text of a feature."""
    far_x, far_y = "x + side", "y + side"
    ring = f"array(array(x, y), array({far_x}, y), array({far_x}, {far_y}), array(x, {far_y}), array(x, y))"
    return _squares(spark, sf).select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.create_map(F.lit("area_code"), F.col("area_code").cast("string")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.expr(f"array({ring})").alias("coordinates")).alias("geometry"),
    )).alias("value"))


@query("geojson_squares", _SQUARES_SQL)
def geojson_squares(spark, sf):
    path = _folder(spark, "geojson")
    _square_features(spark, sf).write.text(path)
    return _measured(polygons.read_geojson(spark, path, "area_code"))


@query("geojson_collections", _SQUARES_SQL)
def geojson_collections(spark, sf):
    """Feature collections, one JSON document a file, read by byte ranges."""
    def collected(frames):
        yield pd.DataFrame({"value": ['{"type": "FeatureCollection", "features": [']})
        comma = ""
        for frame in frames:
            if len(frame):
                lines = frame["value"].tolist()
                yield pd.DataFrame({"value": [comma + lines[0], *["," + line for line in lines[1:]]]})
                comma = ","
        yield pd.DataFrame({"value": ["]}"]})

    path = _folder(spark, "collections")
    _square_features(spark, sf).mapInPandas(collected, "value string").write.text(path)
    return _measured(polygons.read_polygons(spark, path, "area_code", fmt="geojson"))


@query("wkb_squares", _SQUARES_SQL)
def wkb_squares(spark, sf):
    def encode(frames):
        for frame in frames:
            rings = [
                (x, y, x + s, y, x + s, y + s, x, y + s, x, y) for x, y, s in zip(frame["x"], frame["y"], frame["side"])
            ]
            yield pd.DataFrame({"area_code": frame["area_code"], "geometry": [
                struct.pack("<BIII10d", 1, 3, 1, 5, *ring) for ring in rings
            ]})

    stored = _folder(spark, "wkb")
    _squares(spark, sf).mapInPandas(encode, "area_code long, geometry binary").write.parquet(stored)
    return _measured(polygons.read_polygons(spark, stored, "area_code", fmt="wkb"))


def _box(df):
    x, y, side = (F.col(c).cast("double") for c in ("x", "y", "side"))
    corners = ((x, y), (x + side, y), (x + side, y + side), (x, y + side))
    pts = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    ring = F.struct(F.lit(False).alias("is_hole"), pts.alias("pts"))
    return spatial.polygons_from_rings(df.withColumn("rings", F.array(ring)).drop("x", "y", "side"))


@query("masked_polygons", f"""WITH a AS (
  SELECT c_custkey AS area_code, {_X0} AS x, {_Y0} AS y, {_SIDE} AS s FROM customer),
m AS (SELECT s_suppkey % 10 * 400 + 55 AS x, s_suppkey // 10 * 400 + 55 AS y, 120 AS s FROM supplier)
SELECT DISTINCT area_code FROM a JOIN m ON
  greatest(m.x - (a.x + a.s), a.x - (m.x + m.s), 0) ** 2 + greatest(m.y - (a.y + a.s), a.y - (m.y + m.s), 0) ** 2 <= 900""")
def masked_polygons(spark, sf):
    """Stored polygons within 30 of a mask."""
    path, key = _folder(spark, "polygons"), F.col("s_suppkey")
    _box(_squares(spark, sf)).write.parquet(path)
    mask = _box(table(spark, sf, "supplier").select(
        key.alias("mask_id"), (key % 10 * 400 + 55).alias("x"), (F.floor(key / 10) * 400 + 55).alias("y"), F.lit(120).alias("side")
    ))
    return polygons.read_polygons_in(spark, path, mask, 30.0).select("area_code")


@query("rank_shift_published", f"""WITH {_ALTERNATIVES_SQL}, ranked AS (SELECT *, {_RANKED_SQL} FROM alternatives)
SELECT scenario, round(pearson_r, 6) AS pearson_r, round(spearman_rho, 6) AS spearman_rho,
       round(mean_rank_shift, 6) AS mean_rank_shift FROM ({_shift_sql("equal_score")})""")
def rank_shift_published(spark, sf):
    """Scores compared with a baseline that was published as a table of its own."""
    path, found = _folder(spark, "baseline"), _alternatives(spark, sf)
    tables.write_table(found.select("area_code", "composite_score"), path)
    published = spark.read.parquet(path).withColumnRenamed("composite_score", "published")
    joined = robustness.join_baseline(found.select("area_code", "equal_score"), published, ["area_code"])
    shifts = robustness.rank_shift(joined, "published", ["equal_score"])
    return rounded(shifts, "pearson_r", "spearman_rho", "mean_rank_shift")
