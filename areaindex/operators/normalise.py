"""Scaling to 0-100, z-scores, ranks within the whole, descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.operators.ordering import average_rank, quantiles, with_position
from areaindex.session import checkpointed, join_null_safe, one_row

# Score name -> (raw column, whether a low raw value is good).
SCORE_SPEC = {
    "air_quality_no2": ("no2_mean_concentration", True),
    "air_quality_pm25": ("pm25_mean_concentration", True),
    "crime": ("crime_rate_per_1000", True),
    "income": ("Income_Rate", True),
    "employment": ("Employment_Rate", True),
    "primary_read": ("primary_read_score_weighted", False),
    "primary_math": ("primary_math_score_weighted", False),
    "secondary_progress": ("secondary_progress_8_weighted", False),
    "secondary_attainment": ("secondary_attainment_8_weighted", False),
    "childcare_quality": ("avg_childcare_quality_score", False),
}


def winsor_minmax(
    df: DataFrame, spec: Mapping[str, tuple[str, bool]], lo: float = 0.025, hi: float = 0.975,
    digits: int = 2, by: Sequence[str] = (),
) -> DataFrame:
    """Clip each column to its ``lo``/``hi`` quantiles and scale it to 0-100.

    After clipping the two quantiles are the extremes, so they are all that the
    scaling needs. A column that is constant (or empty) gets 50 everywhere;
    otherwise NULL stays NULL.
    """
    spec = {out: (c, invert) for out, (c, invert) in spec.items() if c in df.columns}
    cols = list(dict.fromkeys(c for c, _ in spec.values()))
    df = checkpointed(df)  # read for the bounds and for the result
    bounds = quantiles(df, cols, [lo, hi], by, stored=True)
    if by:
        bounds = bounds.select(*by, F.struct(*cols).alias("__bounds"))
        bounded = join_null_safe(df, bounds, list(by), "left")
    else:
        bounded = df.withColumn("__bounds", one_row(bounds))

    def score(col: str, invert: bool) -> Column:
        low, high = F.col(f"__bounds.{col}")[0], F.col(f"__bounds.{col}")[1]
        clipped = F.greatest(F.least(F.col(col), high), low)
        part = (high - clipped) if invert else (clipped - low)
        scaled = F.bround(part / F.nullif(high - low, F.lit(0.0)) * 100, digits)
        flat = low.isNull() | (low == high)
        return F.when(flat, F.lit(50.0)).when(F.col(col).isNotNull(), scaled)

    return bounded.withColumns({out: score(*s) for out, s in spec.items()}).drop("__bounds")


def zscore(
    df: DataFrame, cols: Sequence[str], negate: Sequence[str] = (), ddof: int = 0, suffix: str = "_z",
) -> DataFrame:
    """Standardised columns over the rows that have all of them (listwise deletion)."""
    whole = df.na.drop("any", subset=list(cols))
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = whole.agg(*[
        F.struct(F.avg(c).alias("mean"), spread(c).alias("sd")).alias(c) for c in cols
    ])
    sign = {c: -1.0 if c in negate else 1.0 for c in cols}

    def z(c: str) -> Column:
        m, sd = F.col(f"__stats.{c}.mean"), F.col(f"__stats.{c}.sd")
        # A constant column has no spread; its z-scores are all zero.
        return (F.col(c) - m) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0)) * F.lit(sign[c])

    return (
        whole.withColumn("__stats", one_row(stats))
        .withColumns({f"{c}{suffix}": z(c) for c in cols}).drop("__stats")
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sample sd, extremes, population skewness and excess kurtosis; one row per column."""
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("indicator"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
        ).alias(c) for c in cols
    ])
    return stats.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")


def winsor_bounds(
    df: DataFrame, cols: Sequence[str], lo: float = 0.025, hi: float = 0.975
) -> DataFrame:
    """Clipping bounds, quartiles and the number of values outside the bounds, per column."""
    levels = [lo, 0.25, 0.5, 0.75, hi]
    rows = checkpointed(df.select(*cols))  # read for the bounds and for the counts
    found = quantiles(rows, cols, levels, (), stored=True)
    counted = rows.withColumn("__q", one_row(found)).agg(*[
        F.struct(
            F.lit(c).alias("indicator"),
            *[F.max(F.col(f"__q.{c}")[i]).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))],
            F.count_if(F.col(c) < F.col(f"__q.{c}")[0]).alias("below"),
            F.count_if(F.col(c) > F.col(f"__q.{c}")[4]).alias("above"),
        ).alias(c) for c in cols
    ])
    return counted.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")


def percentile_rank(
    df: DataFrame, col: str, by: Sequence[str] = (), lower_is_better: bool = False,
    out: str = "percentile",
) -> DataFrame:
    """Ascending average rank as a share of the values present, in percent.

    With ``lower_is_better`` the reading is turned round: 100 minus the share.
    """
    ranked = average_rank(df, col, by, True, "__rank")
    sizes = df.groupBy(*by).agg(F.count(col).alias("__present"))
    if by:
        ranked = join_null_safe(ranked, sizes, list(by), "left")
    else:
        ranked = ranked.withColumn("__present", sizes.scalar())
    share = F.try_divide(F.col("__rank"), F.col("__present")) * 100
    return ranked.withColumn(out, 100 - share if lower_is_better else share).drop("__rank", "__present")


def deciles(
    df: DataFrame, col: str, tie: Sequence[str], by: Sequence[str] = (), out: str = "decile",
    groups: int = 10,
) -> DataFrame:
    """Decile 10 for the lowest values down to 1 for the highest.

    Values are placed in order (ties by ``tie``), and the n places are cut at
    equal quantiles of 1..n. NULL, and pools with a single distinct value, get
    no decile.
    """
    valued = df.where(F.col(col).isNotNull())
    pool = valued.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__count"), (F.min(col) < F.max(col)).alias("__varies")
    )
    order = [F.col(col), *[F.col(t) for t in tie]]
    placed = with_position(valued, order, by, "__place")
    if by:
        placed = join_null_safe(placed, pool, list(by))
    else:
        placed = placed.withColumn("__pool", one_row(pool)).withColumns({
            "__count": F.col("__pool.__count"), "__varies": F.col("__pool.__varies"),
        }).drop("__pool")
    place, count = F.col("__place"), F.col("__count")
    # Whole-number ceiling of (place - 1) * groups / (count - 1); the quantile
    # edges themselves belong to the lower bin.
    upper = F.floor(((place - 1) * groups + count - 2) / F.nullif(count - 1, F.lit(0)))
    bin_ = F.greatest(F.lit(1), upper)
    decile = F.when(F.col("__varies"), (F.lit(groups + 1) - bin_).cast("int"))
    placed = placed.withColumn(out, decile).drop("__place", "__count", "__varies")
    empty = df.where(F.col(col).isNull()).withColumn(out, F.lit(None).cast("int"))
    return placed.unionByName(empty)

