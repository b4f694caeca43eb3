"""Incident feeds, price series and other dated values."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.clean import month_of
from areaindex.operators.panel import make_grid

# Incident types that count towards community safety.
INCIDENT_TYPES = (
    "Anti-social behaviour",
    "Burglary",
    "Robbery",
    "Criminal damage and arson",
    "Violence and sexual offences",
    "Public order",
)


def relevant_incidents(
    df: DataFrame, required: Sequence[str], type_col: str, types: Sequence[str] = INCIDENT_TYPES
) -> DataFrame:
    return df.na.drop("any", subset=list(required)).where(F.col(type_col).isin(*types))


def monthly_counts(
    df: DataFrame, area: str, ts: str, type_col: str | None = None, types: Sequence[str] = (),
    out: str = "monthly_count",
) -> DataFrame:
    """Incidents per area and month, with one extra column per type.

    Totals and types come from the same pass: counters per type replace a pivot.
    """
    per_type = [F.count_if(F.col(type_col) == t).alias(t) for t in types]
    return df.groupBy(area, month_of(ts).alias("period")).agg(F.count(F.lit(1)).alias(out), *per_type)


def annualise(
    df: DataFrame, area: str, ts: str, grid: DataFrame | None = None, coverage: str = "area"
) -> DataFrame:
    """Yearly incident counts scaled to twelve months.

    The months seen are kept as bits of one integer, so counting them needs no
    distinct aggregate. ``coverage="area"`` counts the months in which the area
    itself has an incident, ``"global"`` those present in the whole feed.
    With a grid, areas without incidents appear as zeros.
    """
    stamped = df.select(
        area, F.year(ts).alias("year"),
        F.call_function("shiftleft", F.lit(1), F.month(ts) - 1).alias("__month"),
    )
    yearly = stamped.groupBy(area, "year").agg(
        F.count(F.lit(1)).alias("raw_count"), F.bit_or("__month").alias("__months")
    )
    if coverage == "global":
        feed = yearly.groupBy("year").agg(F.bit_or("__months").alias("__months"))
        yearly = yearly.drop("__months").join(feed, "year")
    yearly = yearly.withColumn("months_of_data", F.bit_count("__months").cast("long")).drop("__months")
    yearly = yearly.withColumn(
        "annualised_count", F.col("raw_count") / F.col("months_of_data") * F.lit(12.0)
    )
    if grid is not None:
        yearly = grid.join(yearly, [area, "year"], "left").na.fill(
            0, ["raw_count", "months_of_data", "annualised_count"]
        )
    return yearly.withColumn("is_full_year", F.col("months_of_data") == 12)


def incident_grid(areas: DataFrame, feed: DataFrame, area: str, ts: str) -> DataFrame:
    """Every area in every year that the feed covers."""
    return make_grid(areas, feed.select(F.year(ts).alias("year")), area)


def _period_end(start: Column, unit: str) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.last_day(F.add_months(start, months - 1))


def resample(df: DataFrame, key: Sequence[str], ts: str, value: str, unit: str = "month") -> DataFrame:
    """Sum per calendar bucket, labelled by its last day; empty buckets inside the span give 0."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    bucketed = df.groupBy(*key, F.date_trunc(unit, ts).cast("date").alias("__start")).agg(
        F.sum(value).alias(value)
    )
    span = F.sequence(F.min("__start"), F.max("__start"), F.expr(f"INTERVAL {months} MONTH"))
    spine = bucketed.groupBy(*key).agg(span.alias("__starts")).select(
        *key, F.explode("__starts").alias("__start")
    )
    return spine.join(bucketed, [*key, "__start"], "left").select(
        *key, _period_end(F.col("__start"), unit).alias(ts),
        F.coalesce(F.col(value), F.lit(0)).alias(value),
    )


def align(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Two series side by side; dates of either one stay."""
    return a.join(b, list(on), "outer")


def in_year(df: DataFrame, ts: str, year: int | None) -> DataFrame:
    """Rows of one year, or all of them."""
    return df if year is None else df.where(F.year(ts) == year)


def year_options(df: DataFrame, ts: str) -> DataFrame:
    """Years present, latest first."""
    return df.select(F.year(ts).alias("year")).distinct().orderBy(F.desc("year"))


def yearly_means(df: DataFrame, year: str, cols: Sequence[str]) -> DataFrame:
    """Mean per year; years without any value are left out."""
    return df.groupBy(year).agg(*[F.avg(c).alias(c) for c in cols]).na.drop("all", subset=list(cols))


def periods_to_long(
    df: DataFrame, ids: Sequence[str], pattern: str = r"Year ending ([A-Z][a-z]{2} \d{4})",
    fmt: str = "MMM yyyy", value: str = "value", date: str = "date",
) -> DataFrame:
    """Wide period columns to rows dated by the last day of the month in the header."""
    periods = [c for c in df.columns if re.search(pattern, c)]
    if not periods:
        raise ValueError(f"no column matches {pattern!r}")
    text = F.regexp_extract("__period", pattern, 1)
    return (
        df.unpivot(list(ids), periods, "__period", value)
        .withColumn(date, F.last_day(F.to_date(text, fmt)))
        .select(*ids, date, value)
    )


def type_totals(df: DataFrame, types: Sequence[str], name: str = "type", total: str = "total") -> DataFrame:
    """Sum of every type column, largest first."""
    sums = df.agg(*[F.sum(t).alias(t) for t in types])
    return sums.unpivot([], list(types), name, total).orderBy(F.desc(total), name)
