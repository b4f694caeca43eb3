"""Raw published files to clean tables: one function per source."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.functions.clean import (
    drop_missing, grade_score, keep_range, norm_code, norm_postcode, parse_month, to_number,
)
from areaindex.functions.projection import project
from areaindex.operators import panel, series
from areaindex.sources import tables as T

# Headers of the deprivation scores and their short names.
DEPRIVATION_COLUMNS = {
    "Index of Multiple Deprivation (IMD) Score": "IMD_Score",
    "Income Score (rate)": "Income_Rate",
    "Employment Score (rate)": "Employment_Rate",
    "Health Deprivation and Disability Score": "Health_Score",
    "Income Deprivation Affecting Children Index (IDACI) Score (rate)": "IDACI_Rate",
}

# Positions of the postcode file and of the practice register.
POSTCODE_FIELDS = (
    "Postcode", "Positional_quality_indicator", "Eastings", "Northings", "Country_code",
    "NHS_regional_HA_code", "NHS_HA_code", "Admin_county_code", "Admin_district_code", "Admin_ward_code",
)
PRACTICE_POSITIONS = {0: "org_code", 1: "name", 9: "postcode", 25: "setting_code"}

# Candidate headers, in order of preference.
POPULATION_HEADERS = {"area_code": ["lsoa 2021 code", "lsoa21cd"], "population": ["total", "all ages"]}
SURVEY_HEADERS = {
    "org_code": ["ad_practicecode", "practice_code"],
    "satisfaction": ["overallexp.pcteval", "q28_12pct"],
}
PRIMARY_HEADERS = {
    "urn": ["urn"], "name": ["schname"], "postcode": ["pcode"],
    "pass_rate": ["ptrwm_exp"], "read_score": ["read_average"], "math_score": ["mat_average"],
}
SECONDARY_HEADERS = {
    "urn": ["urn"], "name": ["schname"], "postcode": ["pcode"], "nftype": ["nftype"],
    "progress_8": ["p8mea"], "attainment_8": ["att8scr"],
}
CHILDCARE_HEADERS = {
    "urn": ["provider urn"], "name": ["provider name"], "postcode": ["provider postcode"],
    "rating_str": ["most recent full: overall effectiveness"], "places": ["places"],
}

YEAR_IN_NAME = r"(\d{4})"
SCHOOL_YEAR_IN_NAME = r"(\d{4})-(\d{4})"
SURVEY_YEAR_IN_NAME = r"_(\d{4})_"
RELEASE_DATE_IN_NAME = r"as_at_(\d{1,2}_[A-Za-z]+_\d{4})"


def hierarchy(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """Area lookup, cut to the areas in ``codes`` (a frame with area_code)."""
    names = ["LSOA21CD", "WD25CD", "WD25NM", "LAD25CD", "LAD25NM"]
    raw = T.read_csv_projected(spark, path, names).withColumn("area_code", norm_code("LSOA21CD"))
    wanted = codes.select(norm_code("area_code").alias("area_code")).distinct()
    renamed = {"WD25CD": "mid_code", "WD25NM": "mid_name", "LAD25CD": "top_code", "LAD25NM": "top_name"}
    return raw.join(wanted, "area_code", "left_semi").drop("LSOA21CD").withColumnsRenamed(renamed)


def mid_parents(lookup: DataFrame, mids: DataFrame) -> DataFrame:
    """Mid-level areas with the top-level area they belong to; unknown ones are left out."""
    T.require_columns(lookup, ["mid_code", "top_code", "top_name"])
    parent = panel.keep_one(lookup.select("mid_code", "top_code", "top_name"), ["mid_code"], ["top_code"])
    return mids.join(parent, "mid_code", "inner")


def postcodes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """postcode, x, y (grid metres), latitude, longitude."""
    raw = T.read_csv_headerless(spark, paths, POSTCODE_FIELDS, ["Postcode", "Eastings", "Northings"])
    placed = raw.select(
        F.col("Postcode").alias("postcode"), to_number("Eastings").alias("x"), to_number("Northings").alias("y")
    )
    return project(drop_missing(placed, ["x", "y"]), "x", "y")


def geocode(df: DataFrame, places: DataFrame, normalise: bool = True) -> DataFrame:
    """Add x, y by postcode; rows without a match are left out.

    With ``normalise`` blanks and case do not matter, else texts must be equal.
    """
    def key(c: str):
        return norm_postcode(c) if normalise else F.col(c)

    known = panel.keep_one(places.select(key("postcode").alias("__p"), "x", "y"), ["__p"], ["x", "y"])
    return df.withColumn("__p", key("postcode")).join(known, "__p", "inner").drop("__p")


def population(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    raw = T.read_csv_drifting(spark, path, POPULATION_HEADERS, ["area_code", "population"])
    dated = T.key_from_filename(raw, YEAR_IN_NAME, "year")
    clean = dated.select(
        F.trim("area_code").alias("area_code"), "year", to_number("population").alias("population")
    )
    return clean.join(codes.select("area_code").distinct(), "area_code", "left_semi")


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """area_code, month, type of the incidents that count."""
    raw = T.read_csv_projected(spark, path, ["Month", "LSOA code", "Crime type"])
    feed = raw.select(
        F.col("LSOA code").alias("area_code"), parse_month("Month").alias("month"), F.col("Crime type").alias("type")
    )
    return series.relevant_incidents(feed, ["area_code", "month", "type"], "type")


def deprivation(spark: SparkSession, scores_path: str, lookup_path: str) -> DataFrame:
    names = ["LSOA code (2011)", *DEPRIVATION_COLUMNS]
    raw = T.read_csv_projected(spark, scores_path, names)
    scores = raw.select(
        F.col("`LSOA code (2011)`").alias("LSOA11CD"),
        *[to_number(F.col(f"`{c}`")).alias(short) for c, short in DEPRIVATION_COLUMNS.items()],
    )
    lookup = T.read_csv_projected(spark, lookup_path, ["LSOA11CD", "LSOA21CD"])
    moved = panel.concordance(scores, lookup, "LSOA11CD", "LSOA21CD", ["IMD_Score"])
    return moved.drop("LSOA11CD").withColumnRenamed("LSOA21CD", "area_code").withColumn(
        "area_code", F.trim("area_code")
    )


def prices(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """area_code, date, price from one column per period."""
    raw = spark.read.option("header", True).csv(path)
    T.require_columns(raw, ["LSOA code"])
    long = series.periods_to_long(raw.withColumnRenamed("LSOA code", "area_code"), ["area_code"], value="price")
    clean = long.select(
        F.trim("area_code").alias("area_code"), "date", to_number("price").cast("int").alias("price")
    ).na.drop("any")
    return clean.join(codes.select("area_code").distinct(), "area_code", "left_semi")


def practices(spark: SparkSession, path: str, setting: str = "4") -> DataFrame:
    names = [PRACTICE_POSITIONS.get(i, f"c{i}") for i in range(max(PRACTICE_POSITIONS) + 1)]
    raw = T.read_csv_headerless(spark, path, names, list(PRACTICE_POSITIONS.values()), "ISO-8859-1")
    return raw.where(F.col("setting_code") == setting).drop("setting_code")


def survey(spark: SparkSession, path: str) -> DataFrame:
    """org_code, year, satisfaction in percent."""
    raw = T.read_csv_drifting(spark, path, SURVEY_HEADERS, ["org_code", "satisfaction"])
    dated = T.key_from_filename(raw, SURVEY_YEAR_IN_NAME, "year")
    scaled = dated.select(
        F.trim("org_code").alias("org_code"), "year", (to_number("satisfaction") * 100).alias("satisfaction")
    )
    return keep_range(scaled, "satisfaction", 0, 100)


def schools(
    spark: SparkSession, path: str, headers: Mapping[str, Sequence[str]], metrics: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(register with the latest row of each school, yearly results)."""
    raw = T.read_csv_drifting(spark, path, headers, ["urn"], "ISO-8859-1", exclude="provisional")
    for c in headers:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    dated = T.key_from_filename(raw, SCHOOL_YEAR_IN_NAME, "year", group=2)
    dated = dated.where(F.col("urn").isNotNull() & (F.col("urn") != "nan"))
    facts = [c for c in headers if c not in ("urn", *metrics)]
    register = panel.latest_per(dated.select("urn", "year", *facts), ["urn"], ["year", *facts])
    results = dated.select("urn", "year", *[to_number(m).alias(m) for m in metrics])
    return register.drop("year"), panel.keep_one(results, ["urn", "year"], list(metrics), last=True)


def childcare(spark: SparkSession, path: str) -> DataFrame:
    """Latest release of each provider and year: urn, year, name, postcode, rating, places, score."""
    raw = T.read_csv_drifting(spark, path, CHILDCARE_HEADERS, ["urn", "postcode"])
    for c in CHILDCARE_HEADERS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    dated = T.key_from_filename(raw, RELEASE_DATE_IN_NAME, "file_date", fmt="d MMMM yyyy")
    clean = dated.select(
        "urn", F.year("file_date").alias("year"), "file_date", "name", "postcode", "rating_str",
        F.coalesce(to_number("places").cast("int"), F.lit(0)).alias("places"),
        grade_score("rating_str").cast("double").alias("quality_score"),
    )
    return panel.latest_per(clean, ["urn", "year"], ["file_date", "name"]).drop("file_date")


def readings(spark: SparkSession, path: str, pollutants: Sequence[str] = ("no2", "pm25")) -> DataFrame:
    """id, pollutant, year, x, y, value; negative values mean there is no reading.

    The value column is named after pollutant and year, so each file has its
    own, of any year.
    """
    value = re.compile(rf"(?:{'|'.join(pollutants)})\d{{4}}_band_1")
    headers = {"x": ["x"], "y": ["y"], "value": [value]}
    raw = T.key_from_filename(T.read_csv_drifting(spark, path, headers, ["x", "y", "value"]), YEAR_IN_NAME, "year")
    clean = raw.select(
        F.regexp_extract(T.SOURCE_FILE, f"({'|'.join(pollutants)})", 1).alias("pollutant"), "year",
        to_number("x").alias("x"), to_number("y").alias("y"), to_number("value").alias("value"),
    )
    kept = keep_range(drop_missing(clean, ["x", "y"]), "value", 0)
    return kept.withColumn("id", F.xxhash64("pollutant", "year", "x", "y", "value"))
