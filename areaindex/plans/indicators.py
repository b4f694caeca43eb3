"""Clean tables to one indicator table per topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.operators import knn, panel, series, spatial
from areaindex.operators.series import INCIDENT_TYPES
from areaindex.session import checkpointed

# The years that service tables cover.
SERVICE_YEARS = tuple(range(2018, 2026))


def region_areas(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Area polygons with the top-level area each belongs to; every area gets one."""
    chosen = spatial.assign_parent(children, parents, "area_code", "parent_code")
    return children.join(chosen, "area_code")


def monthly_incidents(feed: DataFrame, types: Sequence[str] = INCIDENT_TYPES) -> DataFrame:
    return series.monthly_counts(feed, "area_code", "month", "type", types, "monthly_crime_count")


def annual_incidents(feed: DataFrame, codes: DataFrame, population: DataFrame) -> DataFrame:
    grid = series.incident_grid(codes, feed, "area_code", "month")
    yearly = series.annualise(feed, "area_code", "month", grid)
    return yearly.join(panel.keep_one(population, ["area_code", "year"], ["population"]), ["area_code", "year"], "left").withColumnsRenamed(
        {"raw_count": "raw_crime_count", "annualised_count": "annualized_crime_count"}
    )


def air_quality(areas: DataFrame, readings: DataFrame, pollutants: Sequence[str] = ("no2", "pm25")) -> DataFrame:
    """Mean concentration per area and year; all pollutants and years in one job."""
    tagged = readings.withColumn("series", F.concat_ws("|", "pollutant", "year"))
    means = spatial.mean_in_or_nearest(tagged, areas, "value", by="series")
    parts = F.split("series", r"\|")
    named = means.select("area_code", parts[1].cast("int").alias("year"), parts[0].alias("pollutant"), "value")
    return named.groupBy("area_code", "year").agg(*[
        F.max(F.when(F.col("pollutant") == p, F.col("value"))).alias(f"{p}_mean_concentration") for p in pollutants
    ])


def green_share(areas: DataFrame, green: DataFrame, green_id: str = "id") -> DataFrame:
    return spatial.coverage_pct(areas, green, "area_code", green_id, "greenspace_percentage")


def latest_prices(prices: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Price of the latest period per area, gaps filled from mid level, top level, whole region."""
    latest = panel.latest_snapshot(prices, "date").select("area_code", F.col("price").alias("latest_median_house_price"))
    base = hierarchy.select("area_code", "mid_code", "top_code").join(latest, "area_code", "left")
    filled = panel.cascade_fill(base, "latest_median_house_price", ["mid_code", "top_code"])
    return filled.select("area_code", "latest_median_house_price")


def price_series(prices: DataFrame, hierarchy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(median per mid-level area and date, median of the whole region per date), from one pass."""
    placed = prices.join(hierarchy.select("area_code", "mid_code"), "area_code", "left")
    levels = {"mid": ["mid_code", "date"], "region": ["date"]}
    both = checkpointed(panel.rollup_levels(placed, levels, {"price": "median"}))
    whole = both.withColumn("price", F.col("price").cast("int"))
    return tuple(whole.where(F.col("level") == name).select(*keys, "price") for name, keys in levels.items())


def centroids(areas: DataFrame) -> DataFrame:
    return spatial.polygon_measures(areas).select("area_code", F.col("cx").alias("x"), F.col("cy").alias("y"))


def _every_year(df: DataFrame, years: Sequence[int]) -> DataFrame:
    return df.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))


def practice_table(
    areas: DataFrame, practices: DataFrame, survey: DataFrame, years: Sequence[int] = SERVICE_YEARS
) -> DataFrame:
    """Three nearest practices still in the latest survey, with their result per year."""
    active = panel.active_only(practices, survey, "org_code", "year")
    near = knn.knn_join(centroids(areas), active, 3, point_id="org_code")
    named = near.join(active.select("org_code", F.col("name").alias("gp_name")), "org_code")
    results = panel.keep_one(survey, ["org_code", "year"], ["satisfaction"])
    rows = _every_year(named, years).join(results, ["org_code", "year"], "left")
    return knn.to_rank_wide(rows, ["area_code", "year"], "gp", ["satisfaction", "distance", "gp_name", "org_code"])


def weighted_school_table(
    areas: DataFrame, register: DataFrame, results: DataFrame, metrics: Sequence[str], prefix: str,
    years: Sequence[int] = SERVICE_YEARS,
) -> DataFrame:
    """Distance-weighted results of the three nearest schools, for every area and year."""
    near = knn.knn_join(centroids(areas), register, 3, point_id="urn")
    rows = near.join(results.where(F.col("year").isin(*years)), "urn")
    weighted = knn.distance_weighted(rows, ["area_code", "year"], metrics, name=prefix + "_{}_weighted")
    return panel.make_grid(areas, years).join(weighted, ["area_code", "year"], "left")


def nearest_school_table(
    areas: DataFrame, register: DataFrame, results: DataFrame, metrics: Sequence[str], facts: Sequence[str],
    prefix: str, years: Sequence[int] = SERVICE_YEARS, with_distance: bool = True,
) -> DataFrame:
    """Three nearest schools with name and results per year; data_year where there are any."""
    near = knn.knn_join(centroids(areas), register, 3, point_id="urn").withColumnRenamed("distance", "distance_km")
    named = near.join(register.select("urn", *facts), "urn", "left")
    dated = results.withColumn("data_year", F.col("year"))
    rows = _every_year(named, years).join(dated, ["urn", "year"], "left")
    shown = [*facts, "urn", *(["distance_km"] if with_distance else []), *metrics, "data_year"]
    return knn.to_rank_wide(rows, ["area_code", "year"], prefix, shown)


CHILDCARE_FACTS = ("quality_score", "places", "distance", "name", "rating_str", "urn")


def childcare_table(areas: DataFrame, providers: DataFrame) -> DataFrame:
    """Three nearest providers of each year's register."""
    near = knn.knn_join(centroids(areas), providers, 3, by="year", point_id="urn")
    rows = near.join(providers.drop("x", "y", "postcode"), ["urn", "year"])
    return knn.to_rank_wide(rows, ["area_code", "year"], "childcare", CHILDCARE_FACTS)


def filled_childcare_table(wide: DataFrame, years: Sequence[int] = SERVICE_YEARS) -> DataFrame:
    """Years without a register take the nearest earlier one, else the nearest later one."""
    facts = [c for c in wide.columns if c not in ("area_code", "year")]
    grid = panel.make_grid(wide, years)
    return panel.fill_within(grid.join(wide, ["area_code", "year"], "left"), "area_code", "year", facts)


def latest_details(wide: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Rows of the latest year, with columns under the names they are shown by."""
    return panel.latest_snapshot(wide, "year").withColumnsRenamed(rename)


def panel_sources(tables: dict[str, DataFrame | None], static: Sequence[str]) -> list[panel.Source]:
    """Sources for the panel; ``static`` names tables that have no year."""
    dropped = {"crime": ("population", "raw_crime_count", "months_of_data", "is_full_year")}
    return [
        panel.Source(name, df, ("area_code",) if name in static else ("area_code", "year"), dropped.get(name, ()))
        for name, df in tables.items()
    ]

