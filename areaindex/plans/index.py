"""From indicator tables to the published index: panel, imputation, scores, weights, composite."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.functions.clean import rate_per
from areaindex.operators import impute, normalise, panel, weights
from areaindex.session import checkpointed

# Columns that do not change over the years of one area.
STATIC_COLUMNS = (
    "greenspace_percentage",
    "IMD_Score",
    "Income_Rate",
    "Employment_Rate",
    "Health_Score",
    "IDACI_Rate",
    "latest_median_house_price",
)


def assembled(
    codes: DataFrame, years: Sequence[int], sources: Sequence[panel.Source], missing: str = "skip",
) -> DataFrame:
    """Grid with every source joined and static values carried over the years.

    Population is carried forward, then takes the median of its year.
    """
    whole = panel.assemble_panel(panel.make_grid(codes, years), sources, missing, years)
    if "annualized_crime_count" in whole.columns:
        whole = whole.withColumnRenamed("annualized_crime_count", "crime_count")
    static = [c for c in STATIC_COLUMNS if c in whole.columns]
    if static:
        whole = panel.fill_within(whole, "area_code", "year", static)
    if "population" in whole.columns:
        whole = panel.fill_within(whole, "area_code", "year", ["population"], "ffill")
        whole = panel.fill_group_median(whole, ["year"], ["population"])
    return whole


def _whole_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c).cast("double"), 0) for c in impute.WHOLE_NUMBERS if c in df.columns})


def time_series_panel(whole: DataFrame) -> DataFrame:
    """The panel as observed: service summaries added, nothing imputed."""
    return _whole_numbers(panel.summarise_services(whole))


def imputed_panel(whole: DataFrame, year: int, runs: int = 5, sweeps: int = 10, seed: int = 0) -> DataFrame:
    """One year with gaps filled: mean of the runs, service summaries included."""
    one = checkpointed(whole.where(F.col("year") == year))
    cols = impute.imputable_columns(one)
    filled = impute.impute_chained(
        one, ["area_code", "year"], cols, runs, sweeps, bounds=impute.BOUNDS, whole=impute.WHOLE_NUMBERS, seed=seed
    )
    return impute.mean_over_runs(
        panel.summarise_services(filled), ["area_code", "year"], whole=impute.WHOLE_NUMBERS
    )


def scored(imputed: DataFrame) -> DataFrame:
    """0-100 scores of the ten indicators, with the raw values beside them."""
    if {"crime_count", "population"} <= set(imputed.columns):
        imputed = imputed.withColumn("crime_rate_per_1000", rate_per("crime_count", "population"))
    spec = {f"{name}_score": rule for name, rule in normalise.SCORE_SPEC.items()}
    out = normalise.winsor_minmax(imputed, spec)
    raw = [c for c, _ in normalise.SCORE_SPEC.values() if c in out.columns]
    return out.select("area_code", "year", *[s for s in spec if s in out.columns], *raw)


@dataclass(frozen=True)
class Index:
    scores: DataFrame
    loadings: DataFrame
    weights: DataFrame
    composite: DataFrame


def built(scores: DataFrame, components: int = 5) -> Index:
    """Weights derived from the scores and the composite made with them."""
    stored = checkpointed(scores)
    wanted = [s for members in weights.PILLAR_SCORES.values() for s in members]
    cols = [s for s in wanted if s in stored.columns]
    loadings = weights.rotated_loadings(stored.sparkSession, weights.pca(stored, cols), components)
    table = weights.indicator_weights(loadings)
    named = weights.composite(stored, table, weights.PILLAR_NAMES, "Final_CI_Score")
    kept = [c for c in named.columns if c in cols or c not in (*stored.columns, "weight_total", "Final_CI_Score")]
    return Index(stored, loadings, table, named.select("area_code", "year", "Final_CI_Score", *kept))


def dashboard_table(
    context: DataFrame, composite: DataFrame, hierarchy: DataFrame, year: int | None = None,
    decile_by: Sequence[str] = ("year",),
) -> DataFrame:
    """What the pages show: context, scores, names, deprivation deciles and running numbers."""
    scores = composite.select("area_code", "year", *[c for c in composite.columns if c not in context.columns])
    whole = context.join(scores, ["area_code", "year"], "left")
    if year is not None:
        whole = whole.where(F.col("year") == year)
    whole = whole.join(hierarchy, "area_code", "left").na.fill("Uncategorised", ["mid_name"])
    for col, out in (
        ("IMD_Score", "IMD_Decile"), ("Income_Rate", "Income_Decile"), ("Employment_Rate", "Employment_Decile"),
        ("Health_Score", "Health_Decile"), ("IDACI_Rate", "IDACI_Decile"),
    ):
        if col in whole.columns:
            whole = normalise.deciles(whole, col, ["area_code", "year"], list(decile_by), out)
    numbered = panel.running_number(whole, ["mid_name", "year"], ["area_code"])
    return numbered.withColumn(
        "display_name", F.concat("mid_name", F.lit(" - Neighbourhood "), F.col("neighbourhood_num").cast("string"))
    )


# How area values are rolled up to the mid level.
MID_ROLLUP = {
    "Final_CI_Score": "mean",
    "Socio-Economic_Deprivation_Score": "mean",
    "Environmental_Safety_Score": "mean",
    "Secondary_Education_Score": "mean",
    "Primary_Education_Score": "mean",
    "Childcare_Quality_Score": "mean",
    "greenspace_percentage": "mean",
    "no2_mean_concentration": "mean",
    "pm25_mean_concentration": "mean",
    "crime_rate_per_1000": "mean",
    "avg_primary_scaled_score": "mean",
    "avg_ks2_pass_rate": "mean",
    "avg_progress_8": "mean",
    "avg_attainment_8": "mean",
    "avg_distance_to_gp_km": "mean",
    "avg_gp_satisfaction": "mean",
    "avg_distance_to_childcare_km": "mean",
    "avg_childcare_quality_score": "mean",
    "total_childcare_places_nearby": "mean",
    "population": "sum",
    "latest_median_house_price": "mean",
    "IMD_Decile": "mean",
    "Income_Decile": "mean",
    "Employment_Decile": "mean",
    "Health_Decile": "mean",
    "IDACI_Decile": "mean",
}
MID_WHOLE = (
    "latest_median_house_price", "IMD_Decile", "Income_Decile", "Employment_Decile", "Health_Decile", "IDACI_Decile",
)


def mid_table(dashboard: DataFrame) -> DataFrame:
    """Mid-level means and totals, with the top-level code attached again."""
    rolled = panel.rollup(dashboard, ["mid_code", "mid_name"], MID_ROLLUP, zero_fill=MID_WHOLE)
    parent = panel.keep_one(
        dashboard.select("mid_code", "top_code").na.drop("any"), ["mid_code"], ["top_code"]
    )
    return rolled.join(parent, "mid_code", "left")
