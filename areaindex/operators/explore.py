"""What people ask of the finished table: rankings, comparisons, trends, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.session import one_row

# Indicator -> whether a low value is the good one.
LOWER_IS_BETTER = {
    "Final_CI_Score": False,
    "Socio-Economic_Deprivation_Score": False,
    "Environmental_Safety_Score": False,
    "Secondary_Education_Score": False,
    "Primary_Education_Score": False,
    "Childcare_Quality_Score": False,
    "greenspace_percentage": False,
    "no2_mean_concentration": True,
    "pm25_mean_concentration": True,
    "crime_rate_per_1000": True,
    "avg_distance_to_gp_km": True,
    "avg_gp_satisfaction": False,
    "primary_pass_rate_weighted": False,
    "primary_read_score_weighted": False,
    "secondary_progress_8_weighted": False,
    "secondary_attainment_8_weighted": False,
    "avg_distance_to_childcare_km": True,
    "avg_childcare_quality_score": False,
    "total_childcare_places_nearby": False,
    "population": False,
    "latest_median_house_price": True,
    "IMD_Decile": True,
    "Income_Decile": True,
    "Employment_Decile": True,
    "Health_Decile": True,
}


def rank_areas(
    df: DataFrame, indicator: str, n: int, key: str, top: bool = True,
    lower_is_better: bool | None = None, within: Column | None = None,
) -> DataFrame:
    """Best (or worst) ``n`` areas by an indicator; areas without a value come last either way.

    The direction is the catalogue's; an indicator outside it needs one.
    """
    if lower_is_better is None and indicator not in LOWER_IS_BETTER:
        raise ValueError(f"say whether a low value of {indicator} is the good one")
    low = LOWER_IS_BETTER[indicator] if lower_is_better is None else lower_is_better
    if within is not None:
        df = df.where(within)
    value = F.col(f"`{indicator}`")
    order = value.asc_nulls_last() if low == top else value.desc_nulls_last()
    return df.orderBy(order, F.col(key)).limit(n)


def options(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, sorted."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def compare_areas(df: DataFrame, key: str, areas: Sequence, indicators: Sequence[str]) -> DataFrame:
    """One row per indicator, one column per chosen area."""
    if len(areas) > 5:
        raise ValueError("compare up to five areas at a time")
    present = [c for c in indicators if c in df.columns]
    chosen = df.where(F.col(key).isin(*areas)).select(key, *[F.col(c).cast("double") for c in present])
    long = chosen.unpivot([key], present, "indicator", "value")
    return long.groupBy("indicator").agg(*[
        F.max(F.when(F.col(key) == a, F.col("value"))).alias(str(a)) for a in areas
    ])


def area_years(df: DataFrame, within: Column, cols: Mapping[str, str]) -> DataFrame:
    """Rows of one place, with those columns that exist under their shown names."""
    return df.where(within).select(*[F.col(c).alias(shown) for c, shown in cols.items() if c in df.columns])


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` over rows that have both."""
    num = {c: F.col(c).try_cast("double") for c in (x, y)}
    pairs = df.select(num[x].alias("x"), num[y].alias("y")).na.drop("any")
    return pairs.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in bins of equal width between the extremes; empty bins are kept."""
    ends = one_row(df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")))
    binned = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v")).withColumn("e", ends)
    share = (F.col("v") - F.col("e.lo")) / F.nullif(F.col("e.hi") - F.col("e.lo"), F.lit(0.0))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = binned.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("e", ends)
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return spine.join(counts, "bin", "left").select(
        "bin", (F.col("e.lo") + F.col("bin") * width).alias("lower"),
        (F.col("e.lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def history_pivot(
    df: DataFrame, entity: str, year: str, value: str, years: Sequence[int] | None = None, agg: str = "mean",
    digits: int | None = None, default: str | None = None,
) -> DataFrame:
    """One row per entity, one column per year (named after it); all years present unless some are named."""
    if years is None:
        years = [r[0] for r in df.select(year).where(F.col(year).isNotNull()).distinct().orderBy(year).collect()]

    def cell(y: int) -> Column:
        hit = F.when(F.col(year) == y, F.col(value))
        found = F.avg(hit) if agg == "mean" else F.min(hit)
        if digits is not None:
            found = F.bround(found, digits)
        return (F.coalesce(found, F.lit(default)) if default is not None else found).alias(str(y))

    return df.where(F.col(year).isin(*years)).groupBy(entity).agg(*[cell(y) for y in years])


def sample_audit(df: DataFrame, key: str, k: int = 5, seed: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """All rows of ``k`` areas drawn by the MD5 of their key and the seed, sorted."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    drawn = df.select(key).distinct().orderBy(draw, key).limit(k)
    return df.join(drawn, key, "left_semi").orderBy(key, *order)
