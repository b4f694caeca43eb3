"""The whole rebuild in one call: raw files in, every table of the index out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.operators import spatial
from areaindex.plans import index, indicators, raw
from areaindex.session import co_partitioned
from areaindex.sources import polygons
from areaindex.sources import tables as T

#: What a rebuild reads: names of the inputs whose places the caller gives.
INPUTS = (
    "areas", "tops", "green", "lookup", "postcodes", "population", "incidents", "air", "deprivation", "concordance",
    "prices", "practices", "survey", "primary", "secondary", "childcare",
)

PRIMARY_METRICS = ("pass_rate", "read_score", "math_score")
SECONDARY_METRICS = ("progress_8", "attainment_8")

#: Tables joined to the panel, by their name there; those without a year come last.
PANEL_TABLES = {
    "crime": "annual_incidents", "air": "air_quality", "primary": "primary_weighted", "secondary": "secondary_weighted",
    "gp": "practices_wide", "care": "childcare_filled", "green": "green_share", "imd": "deprivation", "prices": "latest_prices",
}
WITHOUT_YEAR = ("green", "imd", "prices")


class Store:
    """Tables below one folder, each written once and read from there by all that follows.

    With ``resume`` a table that an earlier rebuild finished is kept, so a
    rebuild that was cut short goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, resume: bool = False):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume
        self.paths: dict[str, str] = {}

    def _finished(self, path: str) -> bool:
        try:
            T.require_files(self.spark, [f"{path}/_SUCCESS"])
        except FileNotFoundError:
            return False
        return True

    def put(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not (self.resume and self._finished(path)):
            T.write_table(make(), path)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])


def panel_in_buckets(
    spark: SparkSession, store: Store, codes: DataFrame, years: Sequence[int], buckets: int, database: str = "default",
) -> DataFrame:
    """The panel of all sources, joined bucket by bucket.

    Each source is shuffled once, when it is put in buckets by area. An area has
    a row per year at most in a bucket, so none is hot. The catalog holds the
    tables in buckets while the panel is written; their files stay in the folder.
    """
    run, made = uuid.uuid4().hex, []

    def bucketed(name: str, df: DataFrame) -> DataFrame:
        made.append(f"{database}.panel_{name}_{run}")
        return T.write_bucketed(df, made[-1], ["area_code"], buckets, f"{store.folder}/buckets/{name}")

    def joined() -> DataFrame:
        tables = {"population": "population", **PANEL_TABLES}
        stored = {name: bucketed(name, store[table]) for name, table in tables.items()}
        areas = bucketed("areas", codes.distinct())
        return index.assembled(areas, years, indicators.panel_sources(stored, WITHOUT_YEAR), "fail")

    with co_partitioned(spark):
        whole = store.put("panel", joined)
    for name in made:
        spark.sql(f"DROP TABLE {name}")
    return whole


def rebuild(
    spark: SparkSession, inputs: Mapping[str, str], folder: str, years: Sequence[int] = indicators.SERVICE_YEARS,
    year: int | None = None, runs: int = 5, sweeps: int = 10, seed: int = 0, green_id: str = "id", resume: bool = False,
    buckets: int | None = None, database: str = "default",
) -> dict[str, str]:
    """Write every table below ``folder`` and return where each of them lies.

    ``inputs`` gives the place of each of ``INPUTS``; all that are missing are
    named in one error before any work. ``year`` is the year that is imputed,
    scored and published, the last of ``years`` by default. Every table is
    written before others are made from it. The panel is joined in ``buckets``,
    as many as a shuffle has partitions unless given.
    """
    absent = [name for name in INPUTS if name not in inputs]
    if absent:
        raise ValueError(f"inputs without a place: {', '.join(absent)}")
    T.require_files(spark, [inputs[name] for name in INPUTS])
    store = Store(spark, folder, resume)
    put, year = store.put, max(years) if year is None else year

    areas = put("areas", lambda: polygons.read_polygons(spark, inputs["areas"], "area_code", "name"))
    tops = put("tops", lambda: polygons.read_polygons(spark, inputs["tops"], "parent_code"))
    codes = areas.select("area_code")
    put("region_areas", lambda: indicators.region_areas(areas, tops))
    lookup = put("hierarchy", lambda: raw.hierarchy(spark, inputs["lookup"], codes))
    posts = put("postcodes", lambda: raw.postcodes(spark, inputs["postcodes"]))
    people = put("population", lambda: raw.population(spark, inputs["population"], codes))

    feed = put("incidents", lambda: raw.incidents(spark, inputs["incidents"]))
    put("monthly_incidents", lambda: indicators.monthly_incidents(feed))
    put("annual_incidents", lambda: indicators.annual_incidents(feed, codes, people))
    readings = put("readings", lambda: raw.readings(spark, inputs["air"]))
    put("air_quality", lambda: indicators.air_quality(areas, readings))
    green = put("green", lambda: polygons.read_polygons(spark, inputs["green"], green_id))
    put("green_share", lambda: indicators.green_share(areas, green, green_id))
    put("deprivation", lambda: raw.deprivation(spark, inputs["deprivation"], inputs["concordance"]))

    prices = put("price_series_area", lambda: _price(raw.prices(spark, inputs["prices"], codes)))
    plain = prices.withColumnRenamed("median_house_price", "price")
    series = cache(lambda: indicators.price_series(plain, lookup))
    put("price_series_mid", lambda: _price(series()[0]))
    put("price_series_region", lambda: _price(series()[1]))
    put("latest_prices", lambda: indicators.latest_prices(plain, lookup))

    survey = put("survey", lambda: raw.survey(spark, inputs["survey"]))
    practices = put("practices", lambda: raw.geocode(raw.practices(spark, inputs["practices"]), posts))
    put("practices_wide", lambda: indicators.practice_table(areas, practices, survey, years))
    care = put("childcare", lambda: raw.geocode(raw.childcare(spark, inputs["childcare"]), posts))
    wide = put("childcare_wide", lambda: indicators.childcare_table(areas, care))
    put("childcare_filled", lambda: indicators.filled_childcare_table(wide, years))

    for kind, headers, metrics, prefix, facts, far in (
        ("primary", raw.PRIMARY_HEADERS, PRIMARY_METRICS, "primary_school", ["name"], True),
        ("secondary", raw.SECONDARY_HEADERS, SECONDARY_METRICS, "school", ["name", "nftype"], False),
    ):
        found = raw.schools(spark, inputs[kind], headers, metrics)
        register = put(f"{kind}_schools", lambda f=found: raw.geocode(f[0], posts, normalise=False))
        results = put(f"{kind}_results", lambda f=found: f[1])
        put(f"{kind}_weighted", lambda: indicators.weighted_school_table(areas, register, results, metrics, kind, years))
        put(f"{kind}_deep_dive", lambda: indicators.nearest_school_table(
            areas, register, results, metrics, facts, prefix, years, far
        ))

    whole = panel_in_buckets(spark, store, codes, years, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), database)
    observed = put("panel_observed", lambda: index.time_series_panel(whole))
    imputed = put("panel_imputed", lambda: index.imputed_panel(whole, year, runs, sweeps, seed))
    scores = put("scores", lambda: index.scored(imputed))
    result = cache(lambda: index.built(scores))
    put("loadings", lambda: result().loadings)
    put("weights", lambda: result().weights)
    composite = put("composite", lambda: result().composite)
    board = put("dashboard", lambda: index.dashboard_table(observed, composite, lookup, year))
    put("mid_level", lambda: index.mid_table(board))
    put("neighbours", lambda: spatial.neighbours(areas))
    return store.paths


def _price(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("int")).withColumnRenamed("price", "median_house_price")
