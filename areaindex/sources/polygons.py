"""Polygon readers: GeoJSON text and WKB columns to edge arrays."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.functions.geometry import RINGS_TYPE
from areaindex.functions.projection import rings_to_grid
from areaindex.operators.spatial import BOX, polygons_from_rings, within_distance
from areaindex.sources.features import read_feature_texts
from areaindex.sources.tables import require_columns

_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"
_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def _rings(parts: F.Column) -> F.Column:
    def ring(points: F.Column, place: F.Column) -> F.Column:
        pts = F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return F.struct((place > 0).alias("is_hole"), pts.alias("pts"))
    return F.flatten(F.transform(parts, lambda part: F.transform(part, ring)))


def read_geojson(
    spark: SparkSession, path: str, id_col: str, name_col: str | None = None, lines: bool = True,
    degrees: bool = False,
) -> DataFrame:
    """Polygons of a GeoJSON file: columns id_col, name_col, edges and the bounding box.

    Coordinates in ``degrees`` become grid metres on the way. With ``lines`` there is one feature per line; otherwise files are
    feature collections. Either form is read by many tasks.
    """
    if lines:
        features = spark.read.schema("properties map<string,string>, geometry struct<type:string,coordinates:string>").json(path)
    else:
        typed = read_feature_texts(spark, path).select(F.from_json("feature", _FEATURE).alias("f"))
        features = typed.where("f.type = 'Feature'").select("f.properties", "f.geometry")
    text = F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(text, _POLYGON))).when(
        F.col("geometry.type") == "MultiPolygon", F.from_json(text, _MULTI)
    )
    names = [id_col, *([name_col] if name_col else [])]
    fields = [F.col("properties")[n].alias(n) for n in names]
    shaped = features.select(*fields, _rings(parts).alias("rings")).where(F.col("rings").isNotNull())
    if degrees:
        shaped = shaped.withColumn("rings", rings_to_grid(F.col("rings")))
    return polygons_from_rings(shaped)


def _rings_of(data: bytes) -> list[tuple[bool, np.ndarray]]:
    """(is a hole, points) of every ring of a WKB polygon or multi-polygon; holes are all rings but the first of a part."""
    rings: list[tuple[bool, np.ndarray]] = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        kind, count = struct.unpack_from(order + "II", data, at + 1)
        at += 9
        if kind == 6:
            for _ in range(count):
                at = read(at)
            return at
        if kind != 3:
            raise ValueError(f"not a polygon: WKB type {kind}")
        for place in range(count):
            (size,) = struct.unpack_from(order + "I", data, at)
            rings.append((place > 0, np.frombuffer(data, f"{order}f8", 2 * size, at + 4).reshape(size, 2)))
            at += 4 + 16 * size
        return at

    read(0)
    return rings


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _ring_arrays(shapes: pa.Array) -> pa.Array:
    """The rings of a column of WKB, as nested Arrow lists over flat coordinates."""
    decoded = [_rings_of(g.as_buffer().to_pybytes()) for g in shapes]
    rings = [ring for shape in decoded for ring in shape]
    points = np.concatenate([np.zeros((0, 2)), *[pts for _, pts in rings]]).astype(np.float64)
    pts = _lists([len(r) for _, r in rings], pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
    parts = pa.StructArray.from_arrays([pa.array([hole for hole, _ in rings], pa.bool_()), pts], ["is_hole", "pts"])
    return _lists([len(shape) for shape in decoded], parts)


def decode_wkb(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Polygon rows from a WKB column; decoding runs on Arrow batches, the other columns pass through untouched."""
    names = [c for c in df.columns if c != geometry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != geometry), f"rings {RINGS_TYPE}"])

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, _ring_arrays(batch.column(len(names)))], names=[*names, "rings"])

    ordered = df.where(F.col(f"`{geometry}`").isNotNull()).select(*[F.col(f"`{c}`") for c in (*names, geometry)])
    return polygons_from_rings(ordered.mapInArrow(batches, schema))


def read_polygons(
    spark: SparkSession, path: str, id_col: str, name_col: str | None = None, fmt: str = "geojsonl",
) -> DataFrame:
    """Polygons from ``geojsonl`` (a feature per line), ``geojson`` or parquet with ``wkb``."""
    if fmt in ("geojsonl", "geojson"):
        return read_geojson(spark, path, id_col, name_col, lines=fmt == "geojsonl")
    if fmt == "wkb":
        df = require_columns(spark.read.parquet(path), [id_col, "geometry"])
        return decode_wkb(df.select(id_col, *([name_col] if name_col else []), "geometry"))
    raise ValueError(f"unknown polygon format {fmt!r}")


def read_polygons_in(spark: SparkSession, path: str, mask: DataFrame, buffer: float, id_col: str = "area_code") -> DataFrame:
    """Stored polygons that lie within ``buffer`` of the mask.

    The bounding box of the mask reaches the parquet scan as plain range
    filters, so files and row groups elsewhere are not read.
    """
    box = mask.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    stored = require_columns(spark.read.parquet(path), [id_col, "edges", *BOX])
    if box[0] is None:
        return stored.limit(0)
    near = stored.where(
        (F.col("xmin") <= box[2] + buffer) & (F.col("xmax") >= box[0] - buffer)
        & (F.col("ymin") <= box[3] + buffer) & (F.col("ymax") >= box[1] - buffer)
    )
    return near.join(within_distance(near, mask, buffer, id_col), id_col, "left_semi")
