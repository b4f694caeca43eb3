"""Raw files to the published index, over a small made-up region of 36 areas."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaindex.operators import explore
from areaindex.operators.normalise import SCORE_SPEC
from areaindex.plans import index, indicators, raw
from areaindex.plans.rebuild import INPUTS, rebuild
from areaindex.sources import polygons

SIDE, N = 1000, 36
AREAS = [f"E{i:02d}" for i in range(N)]
MONTHS = [f"2023-{m:02d}" for m in range(1, 13)] + [f"2024-{m:02d}" for m in range(1, 13)]


def corner(i):
    return (i % 6) * SIDE, (i // 6) * SIDE


def square(x, y, w):
    return {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]}


def features(path, items):
    path.write_text("\n".join(json.dumps({"type": "Feature", "properties": p, "geometry": g}) for p, g in items))
    return str(path)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(1)
    paths = {}

    def put(name, text, encoding="utf-8"):
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text.encode(encoding))
        paths[name.split("/")[0]] = str(root / name.split("/")[0])

    paths["areas"] = features(root / "areas.json", [
        ({"area_code": a, "name": f"n{a}"}, square(*corner(i), SIDE)) for i, a in enumerate(AREAS)
    ])
    paths["tops"] = features(root / "tops.json", [
        ({"parent_code": f"T{t}"}, square(t * 3 * SIDE, 0, 3 * SIDE)) for t in range(2)
    ])
    paths["green"] = features(root / "green.json", [({"id": "g0"}, square(0, 0, 500)), ({"id": "g1"}, square(1500, 500, 1000))])
    put("lookup.csv", "LSOA21CD,WD25CD,WD25NM,LAD25CD,LAD25NM,extra\n" + "".join(
        f" {a.lower()} ,W{i // 4},Ward {i // 4},T{i // 18},Top {i // 18},z\n" for i, a in enumerate(AREAS)) + "X99,W9,No,T9,No,z\n")
    put("postcodes.csv", "".join(f'"AB{i} 1CD",10,{corner(i)[0] + 300},{corner(i)[1] + 400},E,h,n,c,d,w\n' for i in range(N)))
    for y in (2023, 2024):
        put(f"pop/pop_{y}.csv", "﻿LSOA21CD,Total\n" + "".join(f'{a},"1,{500 + 7 * i}"\n' for i, a in enumerate(AREAS) if i != 3))
    for m in MONTHS:
        put(f"crime/{m}/c.csv", "Month,LSOA code,Crime type,x\n" + "".join(
            f"{m},{a},{t},1\n" for i, a in enumerate(AREAS) for t in ("Burglary", "Drugs", "Robbery") for _ in range(rng.integers(0, 3)) if i != 5))
    scores = ",".join(f'"{c}"' for c in raw.DEPRIVATION_COLUMNS)
    put("imd.csv", f"LSOA code (2011),{scores}\n" + "".join(
        f"O{i},{10 + i},{.05 + i / 200},{.04 + (i * 7 % 36) / 300},{-1 + i / 18},{.1 + i / 400}\n" for i in range(N) if i != 8))
    put("concord.csv", "LSOA11CD,LSOA21CD\n" + "".join(f"O{i},{a}\n" for i, a in enumerate(AREAS)))
    put("prices.csv", "LSOA code,Year ending Mar 2023,Year ending Dec 2024\n" + "".join(
        f'{a},"{100 + i},000",{"" if i % 5 == 0 else f"{(150 + i)}000"}\n' for i, a in enumerate(AREAS)))
    for y, name in ((2023, "GPPS_2023_Practice_data.csv"), (2024, "GPPS_2024_Practice_data.csv")):
        col = "overallexp.pcteval" if y == 2023 else "q28_12pct"
        put(f"survey/{name}", f"ad_practicecode,{col}\n" + "".join(f"P{i},{.5 + i / 30}\n" for i in range(9 if y == 2024 else 10)) + "P99,-9\n")
    blanks = ",".join(["x"] * 7), ",".join(["x"] * 15)
    put("practices.csv", "".join(f"P{i},Surgery {i},{blanks[0]},ab{i * 3}1cd,{blanks[1]},{4 if i != 2 else 5}\n" for i in range(10)), "latin-1")
    for y in (2023, 2024):
        put(f"ks2/{y - 1}-{y}_england_ks2final.csv", "URN,SCHNAME,PCODE,PTRWM_EXP,READ_AVERAGE,MAT_AVERAGE\n" + "".join(
            f"{100 + i},Primary {i},AB{i * 2} 1CD,{'SUPP' if i == 1 else str(50 + i) + '%'},{100 + i % 5},{101 + i % 7}\n" for i in range(12)), "latin-1")
        put(f"ks4/{y - 1}-{y}_england_ks4final.csv", "URN,SCHNAME,PCODE,NFTYPE,P8MEA,ATT8SCR\n" + "".join(
            f"{200 + i},Second {i},AB{i * 5} 1CD,{'IND' if i == 2 else 'AC'},{(i - 3) / 10},{45 + i + y % 10}\n" for i in range(7)), "latin-1")
        put(f"care/childcare_as_at_31_March_{y}.csv", "Provider URN,Provider Name,Provider Postcode,Most Recent Full: Overall Effectiveness,Places\n" + "".join(
            f"EY{i},Nursery {i},AB{i * 4 + y % 2} 1CD,{1 + i % 4},\"1,0{10 + i}\"\n" for i in range(8)))
        for p in ("no2", "pm25"):
            put(f"air/{p}_{y}.csv", f"X,Y,{p}{y}_Band_1\n" + "".join(
                f"{x + 250},{z + 250},{-1 if (x, z) == (0, 0) else 5 + x / 1000 + z / 2000 + y % 10}\n" for x in range(0, 6000, 1500) for z in range(0, 6000, 1500)))
    return paths


@pytest.fixture(scope="module")
def built(spark, data):
    store = lambda df: df.checkpoint()
    areas = store(polygons.read_polygons(spark, data["areas"], "area_code", "name"))
    tops = polygons.read_polygons(spark, data["tops"], "parent_code")
    placed = store(indicators.region_areas(areas, tops))
    codes = areas.select("area_code")
    lookup = store(raw.hierarchy(spark, data["lookup.csv"], codes))
    posts = store(raw.postcodes(spark, data["postcodes.csv"]))
    people = raw.population(spark, data["pop"], codes)
    feed = store(raw.incidents(spark, data["crime"]))
    prices = store(raw.prices(spark, data["prices.csv"], codes))
    survey = raw.survey(spark, data["survey"])
    practices = raw.geocode(raw.practices(spark, data["practices.csv"]), posts)
    p_metrics, s_metrics = ["pass_rate", "read_score", "math_score"], ["progress_8", "attainment_8"]
    primary, primary_results = raw.schools(spark, data["ks2"], raw.PRIMARY_HEADERS, p_metrics)
    secondary, secondary_results = raw.schools(spark, data["ks4"], raw.SECONDARY_HEADERS, s_metrics)
    primary, secondary = (raw.geocode(d, posts, normalise=False) for d in (primary, secondary))
    care = raw.geocode(raw.childcare(spark, data["care"]), posts)
    years = (2023, 2024)
    tables = {
        "population": people,
        "crime": indicators.annual_incidents(feed, codes, people),
        "air": indicators.air_quality(areas, raw.readings(spark, data["air"])),
        "primary": indicators.weighted_school_table(areas, primary, primary_results, p_metrics, "primary", years),
        "secondary": indicators.weighted_school_table(areas, secondary, secondary_results, s_metrics, "secondary", years),
        "gp": indicators.practice_table(areas, practices, survey, years),
        "care": indicators.childcare_table(areas, care),
        "green": indicators.green_share(areas, polygons.read_polygons(spark, data["green"], "id")),
        "imd": raw.deprivation(spark, data["imd.csv"], data["concord.csv"]),
        "prices": indicators.latest_prices(prices, lookup),
    }
    tables = {k: store(v) for k, v in tables.items()}
    whole = store(index.assembled(
        codes, years, indicators.panel_sources(tables, ("green", "imd", "prices")), "fail"
    ))
    result = index.built(index.scored(index.imputed_panel(whole, 2024, runs=2, sweeps=2)))
    deep = indicators.nearest_school_table(areas, secondary, secondary_results, s_metrics, ["name", "nftype"], "school", years, False)
    return dict(areas=areas, placed=placed, lookup=lookup, posts=posts, feed=feed, prices=prices, tables=tables, whole=whole,
                index=result, deep=deep, care=care)


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_every_area_has_a_parent(built):
    got = {r["area_code"]: r["parent_code"] for r in built["placed"].collect()}
    assert len(got) == N
    assert all(got[a] == f"T{0 if i % 6 < 3 else 1}" for i, a in enumerate(AREAS) if i // 6 < 3)


def test_hierarchy_is_trimmed(built):
    assert built["lookup"].count() == N
    assert one(built["lookup"], area_code="E07")["mid_name"] == "Ward 1"


def test_incidents(built):
    crime = built["tables"]["crime"]
    assert crime.count() == N * 2
    quiet = one(crime, area_code="E05", year=2024)
    assert (quiet["raw_crime_count"], quiet["annualized_crime_count"], quiet["is_full_year"]) == (0, 0.0, False)
    row = one(crime, area_code="E07", year=2024)
    counted = built["feed"].where("area_code = 'E07' AND year(month) = 2024")
    assert row["raw_crime_count"] == counted.count()
    assert {r["type"] for r in built["feed"].select("type").distinct().collect()} == {"Burglary", "Robbery"}
    monthly = indicators.monthly_incidents(built["feed"])
    assert sum(r["Burglary"] + r["Robbery"] for r in monthly.collect()) == built["feed"].count()


def test_topics(built):
    t = built["tables"]
    assert one(t["green"], area_code="E00")["greenspace_percentage"] == pytest.approx(25.0)
    assert one(t["green"], area_code="E01")["greenspace_percentage"] == pytest.approx(25.0)
    assert one(t["green"], area_code="E35")["greenspace_percentage"] == 0.0
    assert t["air"].count() == N * 2
    # The point in the first area has no reading, so the nearest one counts; E06 holds one point.
    assert one(t["air"], area_code="E00", year=2024)["no2_mean_concentration"] > 0
    imd = t["imd"]
    assert imd.count() == N - 1 and imd.where("area_code = 'E08'").count() == 0
    price = {r["area_code"]: r["latest_median_house_price"] for r in t["prices"].collect()}
    assert price["E01"] == 151000 and price["E00"] == 152000  # median of E01, E02, E03
    mid, region = indicators.price_series(built["prices"], built["lookup"])
    assert {str(r["date"]) for r in region.collect()} == {"2023-03-31", "2024-12-31"}
    assert mid.where("mid_code = 'W0'").count() == 2


def test_services(built):
    t = built["tables"]
    gp = one(t["gp"], area_code="E00", year=2024)
    # P2 has another setting and P9 is not in the latest survey.
    assert (gp["gp_1_org_code"], gp["gp_1_distance"]) == ("P0", pytest.approx(np.hypot(200, 100) / 1000))
    assert gp["gp_1_satisfaction"] == pytest.approx(50.0)
    codes = {r[f"gp_{i}_org_code"] for r in t["gp"].collect() for i in (1, 2, 3)}
    assert not codes & {"P2", "P9"}
    care = one(t["care"], area_code="E01", year=2023)
    assert care["childcare_1_urn"] == "EY0" and care["childcare_1_places"] == 1010 and care["childcare_1_quality_score"] == 4.0
    assert one(t["care"], area_code="E00", year=2024)["childcare_1_distance"] == pytest.approx(np.hypot(200, 100) / 1000)
    filled = indicators.filled_childcare_table(t["care"], (2022, 2023, 2024, 2025))
    assert filled.count() == N * 4
    assert one(filled, area_code="E01", year=2022)["childcare_1_urn"] == "EY0"
    latest = indicators.latest_details(t["care"], {"childcare_1_distance": "childcare_1_distance_km"})
    assert latest.count() == N and "childcare_1_distance_km" in latest.columns
    school = one(built["deep"], area_code="E00", year=2024)
    assert (school["school_1_name"], school["school_1_nftype"], school["school_1_data_year"]) == ("Second 0", "AC", 2024)
    primary = one(t["primary"], area_code="E00", year=2024)
    assert 100 <= primary["primary_read_score_weighted"] <= 105


def test_panel(built):
    whole = built["whole"]
    assert whole.count() == N * 2 and whole.select("area_code", "year").distinct().count() == N * 2
    assert whole.where("population IS NULL").count() == 0  # E03 takes the median of its year
    assert one(whole, area_code="E08", year=2024)["IMD_Score"] is None  # not its neighbour's
    observed = index.time_series_panel(whole)
    assert one(observed, area_code="E00", year=2024)["avg_gp_satisfaction"] is not None


def test_index(built):
    result = built["index"]
    scores = [f"{name}_score" for name in SCORE_SPEC]
    assert set(scores) <= set(result.scores.columns)
    assert len(scores) == 10 and result.scores.count() == N
    assert result.scores.where(" OR ".join(f"{c} IS NULL OR {c} < 0 OR {c} > 100" for c in scores)).count() == 0
    per = result.weights.groupBy("component").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in per)
    assert {"Childcare_Quality_Score", "childcare_quality_score_indicator"} <= set(result.composite.columns)
    final = result.composite.where("Final_CI_Score IS NOT NULL")
    assert final.count() == N
    assert all(0 <= r["Final_CI_Score"] <= 100 for r in final.collect())


def test_dashboard(built):
    board = index.dashboard_table(index.time_series_panel(built["whole"]), built["index"].composite, built["lookup"], 2024).checkpoint()
    assert board.count() == N
    assert one(board, area_code="E09")["display_name"] == "Ward 2 - Neighbourhood 2"
    assert {r["IMD_Decile"] for r in board.where("IMD_Score IS NOT NULL").collect()} == set(range(1, 11))
    assert one(board, area_code="E35")["IMD_Decile"] == 1
    mids = index.mid_table(board)
    assert mids.count() == 9 and mids.where("top_code IS NULL").count() == 0
    best = explore.rank_areas(board, "Final_CI_Score", 5, "area_code").collect()
    assert best[0]["Final_CI_Score"] == max(r["Final_CI_Score"] for r in board.collect())


# Columns that each published table must have, the key first.
PUBLISHED = {
    "monthly_incidents": ["area_code", "period", "monthly_crime_count", "Burglary", "Robbery"],
    "annual_incidents": ["area_code", "year", "population", "raw_crime_count", "months_of_data", "annualized_crime_count", "is_full_year"],
    "air_quality": ["area_code", "year", "no2_mean_concentration", "pm25_mean_concentration"],
    "green_share": ["area_code", "greenspace_percentage"],
    "deprivation": ["area_code", "IMD_Score", "Income_Rate", "Employment_Rate", "Health_Score", "IDACI_Rate"],
    "price_series_area": ["area_code", "date", "median_house_price"],
    "price_series_mid": ["mid_code", "date", "median_house_price"],
    "price_series_region": ["date", "median_house_price"],
    "latest_prices": ["area_code", "latest_median_house_price"],
    "practices_wide": ["area_code", "year", *[f"gp_{i}_{c}" for i in (1, 2, 3) for c in ("satisfaction", "distance", "gp_name", "org_code")]],
    "childcare_wide": ["area_code", "year", *[f"childcare_{i}_{c}" for i in (1, 2, 3) for c in indicators.CHILDCARE_FACTS]],
    "primary_weighted": ["area_code", "year", *[f"primary_{c}_weighted" for c in ("pass_rate", "read_score", "math_score")]],
    "secondary_weighted": ["area_code", "year", *[f"secondary_{c}_weighted" for c in ("progress_8", "attainment_8")]],
    "primary_deep_dive": ["area_code", "year", *[f"primary_school_{i}_{c}" for i in (1, 2, 3) for c in (
        "name", "urn", "distance_km", "pass_rate", "read_score", "math_score", "data_year")]],
    "secondary_deep_dive": ["area_code", "year", *[f"school_{i}_{c}" for i in (1, 2, 3) for c in (
        "name", "urn", "nftype", "progress_8", "attainment_8", "data_year")]],
    "scores": ["area_code", "year", *[f"{name}_score" for name in SCORE_SPEC], *[c for c, _ in SCORE_SPEC.values()]],
    "composite": ["area_code", "year", "Final_CI_Score"],
    "dashboard": ["area_code", "year", "display_name", "IMD_Decile"],
    "mid_level": ["mid_code", "mid_name", "top_code", "Final_CI_Score"],
    "neighbours": ["area_code", "neighbour"],
}


def test_rebuild_writes_every_table(spark, data, built, tmp_path):
    places = dict(zip(INPUTS, (data[n] for n in (
        "areas", "tops", "green", "lookup.csv", "postcodes.csv", "pop", "crime", "air", "imd.csv", "concord.csv", "prices.csv",
        "practices.csv", "survey", "ks2", "ks4", "care"))))
    folder = str(tmp_path / "out")
    with pytest.raises(ValueError, match="survey"):
        rebuild(spark, {k: v for k, v in places.items() if k != "survey"}, folder)
    with pytest.raises(FileNotFoundError, match="nowhere.*neither"):
        rebuild(spark, {**places, "air": "/nowhere", "green": "/neither"} | {"areas": "/nowhere"}, folder)
    asked = dict(years=(2023, 2024), runs=2, sweeps=2, buckets=4)
    where = rebuild(spark, places, folder, **asked)
    read = {name: spark.read.parquet(path) for name, path in where.items()}
    for name, columns in PUBLISHED.items():
        assert set(columns) <= set(read[name].columns), name
        assert not read[name].isEmpty(), name
    # as the stages called one by one make them
    same = {"annual_incidents": built["tables"]["crime"], "green_share": built["tables"]["green"], "latest_prices": built["tables"]["prices"],
            "secondary_deep_dive": built["deep"], "hierarchy": built["lookup"]}
    for name, want in same.items():
        assert read[name].exceptAll(want.select(*read[name].columns)).count() == 0 and read[name].count() == want.count(), name
    common = [c for c in built["whole"].columns if not c.startswith("childcare")]
    assert read["panel"].select(common).exceptAll(built["whole"].select(common)).count() == 0 and read["panel"].count() == N * 2
    assert read["composite"].where("Final_CI_Score BETWEEN 0 AND 100").count() == N
    assert spark.sql("SHOW TABLES LIKE 'panel_*'").isEmpty()

    import shutil  # a rebuild that was cut short: what is there stays, what is not is made anew

    stamp = {p: (tmp_path / "out" / p / "_SUCCESS").stat().st_mtime_ns for p in ("air_quality", "panel")}
    shutil.rmtree(where["mid_level"])
    rebuild(spark, places, folder, **asked, resume=True)
    assert stamp == {p: (tmp_path / "out" / p / "_SUCCESS").stat().st_mtime_ns for p in stamp}
    assert spark.read.parquet(where["mid_level"]).count() == 9


def test_panel_in_buckets_needs_no_shuffle(spark, tmp_path):
    """Sources in buckets by area meet on (area, year) and on area without an exchange."""
    from areaindex.operators import panel
    from areaindex.session import co_partitioned
    from areaindex.sources.tables import write_bucketed

    codes = spark.range(200).select(F.format_string("E%03d", "id").alias("area_code"))
    grid = panel.make_grid(codes, range(2018, 2024))
    frames = {"areas": codes, "static": codes.withColumn("s", F.hash("area_code")),
              **{f"yearly{i}": grid.where(F.hash("area_code", "year") % 3 != i).withColumn(f"v{i}", F.xxhash64("area_code", "year") % 100) for i in (0, 1, 2)}}
    tables = {n: write_bucketed(df, f"default.bucket_test_{n}", ["area_code"], 8, str(tmp_path / n)) for n, df in frames.items()}
    held = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")

        def joined(made):
            sources = [panel.Source(n, df, ("area_code",) if n == "static" else ("area_code", "year")) for n, df in made.items() if n != "areas"]
            return panel.assemble_panel(panel.make_grid(made["areas"], range(2018, 2024)), sources)

        plain = sorted(map(tuple, joined(frames).collect()), key=repr)
        with co_partitioned(spark):
            whole = joined(tables)
            plan = whole._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, whole.collect()), key=repr) == plain and len(plain) == 1200
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 5
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
        for n in frames:
            spark.sql(f"DROP TABLE default.bucket_test_{n}")
