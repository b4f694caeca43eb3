"""Readers and writers over small files in the published layouts."""

import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from areaindex.functions.projection import project
from areaindex.operators.spatial import polygon_measures
from areaindex.sources import features, polygons, tables


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_projected_reads_sub_folders(spark, tmp_path):
    head = "Crime ID,Month,LSOA code,Crime type\n"
    put(tmp_path / "2020-01" / "a.csv", head + "1,2020-01,E1,Burglary\n2,2020-01,,Burglary\n")
    put(tmp_path / "2020-02" / "b.csv", head + "3,2020-02,E2,Robbery\n")
    df = tables.read_csv_projected(spark, str(tmp_path), ["Month", "LSOA code", "Crime type"])
    assert sorted(tuple(r) for r in df.na.drop("any").collect()) == [("2020-01", "E1", "Burglary"), ("2020-02", "E2", "Robbery")]
    with pytest.raises(ValueError, match="Nope"):
        tables.read_csv_projected(spark, str(tmp_path), ["Nope"])


def test_projected_refuses_another_header(spark, tmp_path):
    put(tmp_path / "a.csv", "x,y\n1,2\n")
    put(tmp_path / "b.csv", "y,x\n1,2\n")
    with pytest.raises(Exception, match="CSV header|header"):
        tables.read_csv_projected(spark, str(tmp_path), ["x", "y"]).collect()


def test_drifting_headers(spark, tmp_path):
    put(tmp_path / "pop_2019.csv", "﻿LSOA21CD,Total\nE1,\"1,500\"\n")
    put(tmp_path / "pop_2020.csv", "name,All Ages,lsoa 2021 code\nx,7,E2\n")
    put(tmp_path / "pop_2021.csv", "lsoa 2021 code,something\nE3,1\n")
    put(tmp_path / "pop_final.csv", "lsoa21cd,total\nE4,1\n")
    put(tmp_path / "Provisional_2022.csv", "lsoa21cd,total\nE5,1\n")
    names = {"area_code": ["lsoa 2021 code", "lsoa21cd"], "population": ["total", "all ages"]}
    df = tables.read_csv_drifting(spark, str(tmp_path), names, ["area_code", "population"], exclude="provisional")
    dated = tables.key_from_filename(df, r"(\d{4})", "year")
    assert sorted((r["area_code"], r["population"], r["year"]) for r in dated.collect()) == [("E1", "1,500", 2019), ("E2", "7", 2020)]
    whole = tables.read_csv_drifting(spark, str(tmp_path), names, ["area_code"])
    kept = {r["area_code"] for r in tables.exclude_files(whole).collect()}
    assert kept == {"E1", "E2", "E3", "E4"}
    with pytest.raises(ValueError):
        tables.read_csv_drifting(spark, str(tmp_path), {"k": ["absent"]}, ["k"])


def test_drifting_headers_of_many_files(spark, tmp_path):
    """2,000 files in 50 layouts: as many jobs as for 20 files, one scan, blanks and quotes in headers and names."""
    def write(root, n):
        for i in range(n):
            pad = ",".join(f"p{j}" for j in range(i % 25))
            code = ("Area Code", '"AREA CODE "')[i % 2]
            head = ",".join(h for h in (pad, code, f"Balance {2000 + i % 20}") if h)
            put(root / f"part {i % 7}" / f"f {i}.csv", f"\n{head}\n" + "-," * (i % 25) + f'E{i},"{i},5"\n')

    names = {"area_code": ["lsoa code", "area code"], "balance": [re.compile(r"balance[ _]\d{4}")], "absent": ["nowhere"]}

    def read(root):
        group = f"headers-{root.name}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            df = tables.read_csv_drifting(spark, str(root), names, ["area_code", "balance"])
            rows = {(r["area_code"], r["balance"], r["source_file"]) for r in df.collect()}
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        plan = df._jdf.queryExecution().executedPlan().toString()
        return df.columns, rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), plan.count("FileScan csv")

    write(tmp_path / "few", 20)
    write(tmp_path / "many", 2000)
    few, many = read(tmp_path / "few"), read(tmp_path / "many")
    assert many[0] == ["area_code", "balance", "source_file"]
    assert {r[:2] for r in many[1]} == {(f"E{i}", f"{i},5") for i in range(2000)} and len(many[1]) == 2000
    assert {r[:2] for r in few[1]} == {(f"E{i}", f"{i},5") for i in range(20)}
    # listing more than 32 folders or files may take one job more
    assert many[2] <= few[2] + 2 and many[3] == few[3]


def test_headers_in_another_encoding(spark, tmp_path):
    put(tmp_path / "a.csv", "Né,Wert\nx,1\n", "latin-1")
    put(tmp_path / "b.csv", "", "latin-1")
    put(tmp_path / "c.csv", "wert,né,Wert\n2,ÿ\n", "latin-1")
    df = tables.read_csv_drifting(spark, str(tmp_path), {"n": ["né"], "v": ["wert"]}, ["n"], "ISO-8859-1")
    assert sorted((r["n"], r["v"]) for r in df.collect()) == [("x", "1"), ("ÿ", "2")]


def test_date_in_the_file_name(spark, tmp_path):
    put(tmp_path / "childcare_as_at_31_March_2023.csv", "Provider URN\n1\n")
    put(tmp_path / "childcare_as_at_1_August_2022.csv", "provider urn\n2\n")
    df = tables.read_csv_drifting(spark, str(tmp_path), {"urn": ["provider urn"]}, ["urn"])
    got = tables.key_from_filename(df, r"as_at_(\d{1,2}_[A-Za-z]+_\d{4})", "d", fmt="d MMMM yyyy")
    assert sorted((r["urn"], str(r["d"])) for r in got.collect()) == [("1", "2023-03-31"), ("2", "2022-08-01")]


def test_headerless_and_latin1(spark, tmp_path):
    path = put(tmp_path / "epraccur.csv", "A1,Chât Surgery,x,4\nA2,Other,y,9\n", "latin-1")
    df = tables.read_csv_headerless(spark, path, ["code", "name", "skip", "setting"], ["code", "name", "setting"], "ISO-8859-1")
    assert [tuple(r) for r in df.orderBy("code").collect()] == [("A1", "Chât Surgery", "4"), ("A2", "Other", "9")]


def test_contiguous_slices(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "slices")
    tables.write_table(df, path, files=10, order=["id"])
    back = spark.read.parquet(path)
    spans = sorted(
        (r["lo"], r["hi"]) for r in back.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    )
    assert len(spans) == 10 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert tables.read_first(spark, str(tmp_path / "absent"), path).count() == 1000
    with pytest.raises(FileNotFoundError):
        tables.read_first(spark, str(tmp_path / "absent"))
    tables.write_table(df.limit(5), str(tmp_path / "lookup"), files=1, fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "lookup")).columns == ["id", "v"]
    tables.write_table(df.withColumn("year", F.col("id") % 2), str(tmp_path / "by_year"), partition_by=["year"])
    plan = spark.read.parquet(str(tmp_path / "by_year")).where("year = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_registry(spark):
    reg = tables.source_registry(spark, [
        dict(id="b", name="Zeta", attribution="Held {year}, again {year}.", url="http://z"), dict(id="a", name="Alpha", attribution="Plain.", url="http://a"),
    ])
    got = [r["line"] for r in tables.attribution_list(reg, 2024).collect()]
    assert got == ["- **[Alpha](http://a):** Plain.", "- **[Zeta](http://z):** Held 2024, again 2024."]


SQUARE = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]


def feature(code, geometry):
    return {"type": "Feature", "properties": {"LSOA21CD": code, "LSOA21NM": f"Place {code}", "n": 3}, "geometry": geometry}


FEATURES = [
    feature("E1", {"type": "Polygon", "coordinates": [SQUARE, HOLE]}),
    feature("E2", {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[10, 10], [11, 10], [11, 11], [10, 10]]]]}),
    feature("E3", {"type": "Point", "coordinates": [1, 2]}),
]


@pytest.mark.parametrize("fmt", ["geojsonl", "geojson"])
def test_geojson(spark, tmp_path, fmt):
    if fmt == "geojsonl":
        path = put(tmp_path / "a.json", "\n".join(json.dumps(f) for f in FEATURES))
    else:
        path = put(tmp_path / "a.json", json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    df = polygons.read_polygons(spark, path, "LSOA21CD", "LSOA21NM", fmt)
    got = {r["LSOA21CD"]: (r["LSOA21NM"], r["area"]) for r in polygon_measures(df).collect()}
    assert got == {"E1": ("Place E1", 15.0), "E2": ("Place E2", 16.5)}


def wkb(rings, order="<"):
    out = struct.pack(order + "BII", 1 if order == "<" else 0, 3, len(rings))
    for r in rings:
        out += struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *map(float, p)) for p in r)
    return out


def test_wkb_and_masked_read(spark, tmp_path):
    multi = struct.pack("<BII", 1, 6, 2) + wkb([SQUARE]) + wkb([[[10, 10], [11, 10], [11, 11], [10, 10]]], ">")
    rows = [("E1", bytearray(wkb([SQUARE, HOLE]))), ("E2", bytearray(multi)), ("E9", None)]
    spark.createDataFrame(rows, "area_code string, geometry binary").write.parquet(str(tmp_path / "wkb"))
    df = polygons.read_polygons(spark, str(tmp_path / "wkb"), "area_code", fmt="wkb")
    assert {r["area_code"]: r["area"] for r in polygon_measures(df).collect()} == {"E1": 15.0, "E2": 16.5}
    df.write.parquet(str(tmp_path / "edges"))
    mask = df.where("area_code = 'E1'")
    far = polygons.read_polygons_in(spark, str(tmp_path / "edges"), mask, 1.0)
    assert {r["area_code"] for r in far.collect()} == {"E1", "E2"}
    plan = far._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(xmin)" in plan or "LessThanOrEqual(xmin" in plan
    with pytest.raises(ValueError):
        polygons.read_polygons(spark, str(tmp_path / "wkb"), "area_code", fmt="shp")
    point = bytearray(struct.pack("<BIdd", 1, 1, 0.0, 0.0))
    with pytest.raises(Exception, match="not a polygon"):
        polygons.decode_wkb(spark.createDataFrame([("p", point)], "area_code string, geometry binary")).collect()


def test_wkb_leaves_other_columns_as_they_are(spark):
    big = 2**53 + 1
    shape = bytearray(wkb([SQUARE, HOLE]))
    rows = [(None, shape, None), (big, shape, [1]), (big + 2, shape, []), (2**62 + 1, bytearray(wkb([])), [2])]
    df = polygons.decode_wkb(spark.createDataFrame(rows, "id long, geometry binary, tags array<int>").coalesce(1))
    got = {r.id: (r.tags, len(r.edges)) for r in df.collect()}
    assert got == {None: (None, 8), big: ([1], 8), big + 2: ([], 8), 2**62 + 1: ([2], 0)}
    assert polygons.decode_wkb(spark.createDataFrame([], "id long, geometry binary")).count() == 0


def tricky_collection(n, spaces=""):
    """Braces, quotes and backslashes in names, features over many ranges, members before and after."""
    names = ['}{"', "[[", "\\\\", '\\\\"}', "é]}", "", "x" * 300]
    items = [{
        "type": "Feature", "properties": {"id": f"p{i}", "note": names[i % len(names)] * (i % 4)},
        "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1 + i % 3], [i, 1 + i % 3], [i, 0]]]},
    } for i in range(n)]
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "a}"}}, "features": items, "more": [{"type": "no"}]}
    return items, json.dumps(whole, ensure_ascii=False, indent=1 if spaces else None)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("spaces", ["", "\n"])
def test_features_by_ranges(spark, tmp_path, size, spaces):
    """Any cut yields the same features, those of a part of a file closed later included."""
    items, text = tricky_collection(9 if size < 7 else 60, spaces)
    put(tmp_path / "with blank" / "a.json", text)
    put(tmp_path / "with blank" / "b.json", json.dumps({"type": "FeatureCollection", "features": []}))
    put(tmp_path / "with blank" / "c.json", "")
    put(tmp_path / "with blank" / "d.json", '{"type": "FeatureCollection", "features": [{"type": "Feature"}, {"cut')
    found = [json.loads(r["feature"]) for r in features.read_feature_texts(spark, str(tmp_path / "with blank"), size).collect()]
    typed = [f for f in found if f.get("type") == "Feature"]
    assert sorted(map(repr, typed)) == sorted(map(repr, [*items, {"type": "Feature"}]))


def test_blocks_within_a_range(tmp_path, monkeypatch):
    """Blocks are as free as ranges: small ones give the same objects."""
    from pyarrow import fs

    items, text = tricky_collection(40)
    put(tmp_path / "a.json", text)
    size = (tmp_path / "a.json").stat().st_size
    for block in (1, 3, 50):
        monkeypatch.setattr(features, "BLOCK_BYTES", block)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.json")) as file:
            found = [json.loads(t) for t in features._features_of(file, 0, size, False, 0, size)]
        assert [f for f in found if f.get("type") == "Feature"] == items


def test_a_large_collection_is_read_by_many_tasks(spark, tmp_path):
    items, text = tricky_collection(30_000)
    path = put(tmp_path / "large.json", text)
    read = features.read_feature_texts(spark, path, 1 << 18)
    tasks = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == len(items) + 2 and len(tasks) >= 4
    put(tmp_path / "lines.json", "\n".join(json.dumps(f, ensure_ascii=False) for f in items))
    one, other = (
        polygon_measures(polygons.read_geojson(spark, p, "id", lines=lines)).select("id", "area", "cx", "cy")
        for p, lines in ((path, False), (str(tmp_path / "lines.json"), True))
    )
    assert one.count() == len(items) and one.exceptAll(other).count() == 0


def test_geojson_in_degrees(spark, tmp_path):
    corners = spark.createDataFrame([(0, 300000.0, 100000.0), (1, 301000.0, 100000.0), (2, 301000.0, 101000.0), (3, 300000.0, 101000.0)], "i int, e double, n double")
    ring = [[r["longitude"], r["latitude"]] for r in project(corners, "e", "n").orderBy("i").collect()]
    path = put(tmp_path / "deg.json", json.dumps(feature("E1", {"type": "Polygon", "coordinates": [[*ring, ring[0]]]})))
    row = polygon_measures(polygons.read_geojson(spark, path, "LSOA21CD", degrees=True)).first()
    assert row["area"] == pytest.approx(1e6, rel=1e-4) and row["cx"] == pytest.approx(300500, abs=1) and row["cy"] == pytest.approx(100500, abs=1)


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2)], [" URN ", "PtRWM_exp"])
    got = tables.resolve_columns(df, {"urn": ["urn"], "pass": ["nope", "ptrwm_exp"], "gone": ["gone"]})
    assert got.columns == ["urn", "pass"] and tuple(got.first()) == (1, 2)


def test_missing_inputs_are_named_together(spark, tmp_path):
    (tmp_path / "there").mkdir()
    tables.require_files(spark, [str(tmp_path / "there")])
    with pytest.raises(FileNotFoundError, match="missing inputs: .*one.*two"):
        tables.require_files(spark, [str(tmp_path / "one"), str(tmp_path / "there"), str(tmp_path / "two")])
