import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from areaindex.functions import clean
from areaindex.operators import explore, panel, series


def test_fill_does_not_leak_between_areas(spark):
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None), ("b", 2, None), ("c", 1, 9.0)]
    df = spark.createDataFrame(rows, "area string, year int, v double")
    got = {(r["area"], r["year"]): r["v"] for r in panel.fill_within(df, "area", "year", ["v"]).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): None, ("b", 2): None, ("c", 1): 9.0}
    forward = {(r["area"], r["year"]): r["v"] for r in panel.fill_within(df, "area", "year", ["v"], "ffill").collect()}
    assert forward[("a", 1)] is None and forward[("a", 3)] == 5.0


def test_grid_from_list_and_from_frame(spark):
    areas = spark.createDataFrame([("a",), ("b",), ("a",)], "area_code string")
    feed = spark.createDataFrame([(2020,), (2021,), (2020,)], "year int")
    for years in ([2020, 2021], feed):
        got = sorted(tuple(r) for r in panel.make_grid(areas, years).collect())
        assert got == [("a", 2020), ("a", 2021), ("b", 2020), ("b", 2021)]


def test_assemble_panel_duplicates_and_missing(spark):
    grid = spark.createDataFrame([("a", 2020), ("b", 2020)], "area_code string, year int")
    doubled = spark.createDataFrame([("a", 2020, 2.0), ("a", 2020, 1.0), ("a", 2021, 9.0)], "area_code string, year int, v double")
    out = panel.assemble_panel(grid, [panel.Source("v", doubled), panel.Source("none", None)], years=[2020])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2020, 1.0), ("b", 2020, None)]
    with pytest.raises(ValueError, match="none"):
        panel.assemble_panel(grid, [panel.Source("none", None)], missing="fail")


def test_concordance_splits_and_merges(spark):
    scores = spark.createDataFrame([("o1", 1.0), ("o2", 2.0), ("o3", None)], "old string, s double")
    lookup = spark.createDataFrame([("o1", "n1"), ("o2", "n1"), ("o1", "n2"), ("o3", "n3"), ("o9", "n9"), ("o1", "n1")], "old string, new string")
    kept = panel.concordance(scores, lookup, "old", "new", ["s"])
    assert sorted((r["new"], r["old"], r["s"]) for r in kept.collect()) == [("n1", "o1", 1.0), ("n2", "o1", 1.0)]
    every = panel.concordance(scores, lookup, "old", "new", ["s"], keep="all")
    assert sorted((r["new"], r["s"]) for r in every.collect()) == [("n1", 1.0), ("n1", 2.0), ("n2", 1.0)]


def test_not_in_is_null_safe(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), (None,)], "k string")
    assert [r["k"] for r in panel.not_in(left, right, "k").collect()] == ["a"]


def test_rollup_skips_absent_columns(spark):
    df = spark.createDataFrame([("m", 1.0, 3.0), ("m", 2.0, None), ("n", None, None)], "k string, a double, b double")
    out = panel.rollup(df, ["k"], {"a": "mean", "b": "sum", "c": "mean", "a2": "median"}, zero_fill=["a"])
    assert sorted(tuple(r) for r in out.collect()) == [("m", 2, 3.0), ("n", 0, None)]


def test_annualise_quiet_months(spark):
    rows = [("a", dt.date(2020, m, 1)) for m in (1, 1, 2, 12)] + [("b", dt.date(2021, 3, 9))]
    feed = spark.createDataFrame(rows, "area string, d date")
    grid = series.incident_grid(spark.createDataFrame([("a",), ("b",), ("q",)], "area string"), feed, "area", "d")
    got = {(r["area"], r["year"]): (r["raw_count"], r["months_of_data"], r["annualised_count"], r["is_full_year"])
           for r in series.annualise(feed, "area", "d", grid).collect()}
    assert got[("a", 2020)] == (4, 3, 16.0, False)
    assert got[("q", 2021)] == (0, 0, 0.0, False)
    assert len(got) == 6
    whole = {(r["area"], r["year"]): r["months_of_data"] for r in series.annualise(feed, "area", "d", coverage="global").collect()}
    assert whole == {("a", 2020): 3, ("b", 2021): 1}


@pytest.mark.parametrize("unit,rule", [("month", "ME"), ("quarter", "QE"), ("year", "YE")])
def test_resample_matches_pandas(spark, unit, rule):
    days = ["2020-01-31", "2020-02-01", "2020-11-30", "2021-06-15", "2021-06-16"]
    pdf = pd.DataFrame({"d": pd.to_datetime(days), "v": [1, 2, 3, 4, 5]})
    df = spark.createDataFrame([("k", d.date(), int(v)) for d, v in zip(pdf.d, pdf.v)], "k string, d date, v long")
    got = [(str(r["d"]), r["v"]) for r in series.resample(df, ["k"], "d", "v", unit).orderBy("d").collect()]
    want = [(str(i.date()), int(v)) for i, v in pdf.set_index("d").v.resample(rule).sum().items()]
    assert got == want


def test_periods_to_long(spark):
    df = spark.createDataFrame(
        [("a", "1,234", None)], "id string, `Year ending Feb 2020` string, `Year ending Dec 1995` string")
    got = sorted((str(r["date"]), r["value"]) for r in series.periods_to_long(df, ["id"]).collect())
    assert got == [("1995-12-31", None), ("2020-02-29", "1,234")]
    with pytest.raises(ValueError):
        series.periods_to_long(df.select("id"), ["id"])


def test_numbers_behind_text(spark):
    texts = ["12", " 1,234.5 ", "45%", "SUPP", "", "nan", "NaN", "inf", "1e3", "10d", "-.5", "x", None, "0x1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", clean.to_number("t").alias("n")).orderBy("i").collect()]
    assert got == [12.0, 1234.5, 45.0, None, None, None, None, None, 1000.0, None, -0.5, None, None, None]


def test_rates_clips_and_row_means(spark):
    df = spark.createDataFrame([(5.0, 0.0, 1.0, None), (5.0, None, None, None), (5.0, 100.0, 3.0, 5.0)], "c double, p double, x double, y double")
    out = df.select(
        clean.rate_per("c", "p").alias("r"), clean.plain_rate_per("c", "p").alias("q"), clean.row_mean(["x", "y"]).alias("m"),
        clean.row_sum(["x", "y"]).alias("s"), clean.clip_to("y", 1.0, 4.0).alias("k"),
    ).collect()
    assert [tuple(r) for r in out] == [
        (5000.0, None, 1.0, 1.0, None), (5000.0, None, None, 0.0, None), (50.0, 50.0, 4.0, 8.0, 4.0),
    ]


def test_grades(spark):
    df = spark.createDataFrame([("1",), ("4.0",), ("9",), ("Good",), (None,)], "g string")
    got = [tuple(r) for r in df.select(clean.grade_score("g"), clean.grade_label("g")).collect()]
    assert got == [(4, "Outstanding (1)"), (1, "Inadequate (4)"), (None, "Not Assessed"), (None, "N/A"), (None, "N/A")]


def test_service_summaries(spark):
    df = spark.createDataFrame(
        [(80.0, None, 1.0, 3.0, 4, None), (None, None, None, None, None, None)],
        "gp_1_satisfaction double, gp_2_satisfaction double, gp_1_distance double, gp_2_distance double, "
        "childcare_1_places int, childcare_2_places int",
    )
    out = [r.asDict() for r in panel.summarise_services(df).collect()]
    assert (out[0]["avg_gp_satisfaction"], out[0]["avg_distance_to_gp_km"], out[0]["total_childcare_places_nearby"]) == (80.0, 2.0, 4.0)
    assert (out[1]["avg_gp_satisfaction"], out[1]["total_childcare_places_nearby"]) == (None, 0.0)


def test_column_choice(spark):
    df = spark.createDataFrame([(1.0, "x", None, 2)], "gp_1_distance double, gp_1_name string, gp_2_distance double, other int")
    cols = clean.matching_columns(df, ["gp_"], ["distance", "name"])
    assert cols == ["gp_1_distance", "gp_2_distance"]
    assert clean.non_empty_columns(df, cols) == ["gp_1_distance"]


def test_rank_areas_puts_missing_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0)], "k string, v double")
    order = lambda **kw: [r["k"] for r in explore.rank_areas(df, "v", 4, "k", **kw).collect()]
    assert order(top=True, lower_is_better=False) == ["c", "d", "a", "b"]
    assert order(top=False, lower_is_better=False) == ["a", "c", "d", "b"]
    assert order(top=True, lower_is_better=True) == ["a", "c", "d", "b"]
    assert order(within=F.col("v") < 2, lower_is_better=False) == ["a"]


@pytest.mark.parametrize("indicator,best", [("latest_median_house_price", "a"), ("IMD_Decile", "a"), ("population", "b")])
def test_directions_of_the_catalogue(spark, indicator, best):
    df = spark.createDataFrame([("a", 1.0), ("b", 9.0)], f"k string, `{indicator}` double")
    assert explore.rank_areas(df, indicator, 1, "k").first()["k"] == best
    with pytest.raises(ValueError):
        explore.rank_areas(df.withColumnRenamed(indicator, "v"), "v", 1, "k")


def test_histogram_keeps_every_row(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    out = explore.histogram(df, "v", 50).collect()
    assert len(out) == 50 and sum(r["n"] for r in out) == 1000 and any(r["n"] == 0 for r in out) is False
    flat = explore.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 5).collect()
    assert sum(r["n"] for r in flat) == 2


def test_compare_areas_limit(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    with pytest.raises(ValueError):
        explore.compare_areas(df, "k", list("abcdef"), ["v"])


def test_sample_audit_is_repeatable(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("k"), "id")
    once = [tuple(r) for r in explore.sample_audit(df, "k", 5, 1, ["id"]).collect()]
    again = [tuple(r) for r in explore.sample_audit(df.repartition(7), "k", 5, 1, ["id"]).collect()]
    assert once == again and len({k for k, _ in once}) == 5 and len(once) == 50


def test_rollup_to_several_levels(spark):
    """One pass equals a rollup per level; an unknown key is not the same as a key that the level lacks."""
    rows = [("W1", "T1", 1, 4.0), ("W1", "T1", 1, 8.0), ("W2", "T1", 1, None), (None, "T1", 2, 5.0), (None, None, 2, 1.0), ("W3", None, 2, None)]
    df = spark.createDataFrame(rows, "mid string, top string, year int, price double").withColumn("n", F.lit(1)).withColumn("level", F.lit("clash"))
    levels = {"mid": ["mid", "year"], "top": ["top", "year"], "all": ["year"], "ever": []}
    aggs = {"price": "median", "n": "sum", "absent": "mean"}
    got = panel.rollup_levels(df, levels, aggs)
    assert got.columns == ["level", "mid", "year", "top", "price", "n"]
    for name, keys in levels.items():
        one = panel.rollup(df.drop("level"), keys, aggs) if keys else df.agg(F.median("price").alias("price"), F.sum("n").alias("n"))
        want = sorted(map(repr, map(tuple, one.collect())))
        assert sorted(map(repr, map(tuple, got.where(F.col("level") == name).select(*one.columns).collect()))) == want
    alone = panel.rollup_levels(df, levels, {"price": "median"}).where("level = 'mid'")
    assert {(r["mid"], r["year"]): r["price"] for r in alone.collect()} == {("W1", 1): 6.0, ("W2", 1): None, (None, 2): 3.0, ("W3", 2): None}
    assert panel.rollup_levels(df.limit(0), {"mid": ["mid"]}, aggs).count() == 0
    scans = panel.rollup_levels(df, levels, {"n": "sum"})._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert scans == 1


def test_suffixes_tell_shared_columns_apart(spark):
    left = spark.createDataFrame([("a", 1, 2.0), (None, 2, 3.0)], "k string, v int, `own col` double")
    right = spark.createDataFrame([("a", 7, "x")], "k string, V int, note string")
    got = panel.join_suffixed(left, right, ["k"], ("_l", "_r"))
    assert got.columns == ["k", "v_l", "own col", "V_r", "note"]
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", 1, 2.0, 7, "x"), (None, 2, 3.0, None, None)]
    assert panel.join_suffixed(left, right.limit(0), ["k"]).columns == ["k", "v", "own col", "V_y", "note"]
    with pytest.raises(ValueError, match="v_y"):
        panel.join_suffixed(left.withColumn("v_y", F.lit(1)), right.withColumnRenamed("V", "v"), ["k"])
