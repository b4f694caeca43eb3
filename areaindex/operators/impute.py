"""Multiple imputation by chained equations, with the data passes on Spark.

Rows without gaps never change, so their share of every regression is summed
once. Of rows with gaps only the imputed columns are kept per run, as an array.
A visit is one pass over these: tasks bring the rows up to date with the models
of the visits since they were last stored, once a sweep, and add up one
cross-product matrix per run; the driver solves these small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaindex.functions.clean import clip_to, matching_columns
from areaindex.functions.draws import uniform
from areaindex.session import checkpointed

# Indicators to impute by name.
IMPUTED_BY_NAME = (
    "crime_count",
    "no2_mean_concentration",
    "pm25_mean_concentration",
    "IDACI_Rate",
    "IMD_Score",
    "Income_Rate",
    "Employment_Rate",
    "Health_Score",
    "greenspace_percentage",
)

# Prefixes and metric names of service columns to impute.
SERVICE_PREFIXES = ("primary_", "secondary_", "gp_", "childcare_")
SERVICE_METRICS = (
    "pass_rate",
    "read_score",
    "math_score",
    "progress_8",
    "attainment_8",
    "satisfaction",
    "quality_score",
    "places",
    "distance_km",
    "distance",
    "weighted",
)

# Bounds put on each indicator after imputation.
BOUNDS = {
    "Employment_Rate": (0.0, 1.0),
    "IDACI_Rate": (0.0, 1.0),
    "Income_Rate": (0.0, 1.0),
    "IMD_Score": (1.58, 100.0),
    "Health_Score": (-4.0, 4.0),
    "greenspace_percentage": (0.0, 100.0),
    "latest_median_house_price": (106000.0, None),
    "population": (715.0, None),
    "crime_count": (0.0, None),
    "no2_mean_concentration": (1.78, None),
    "pm25_mean_concentration": (2.41, None),
    "primary_math_score_weighted": (60.0, 130.0),
    "primary_read_score_weighted": (60.0, 130.0),
    "primary_pass_rate_weighted": (0.0, 1.0),
    "secondary_attainment_8_weighted": (0.0, 90.0),
    "secondary_progress_8_weighted": (-5.0, 5.0),
}

# Indicators kept as whole numbers.
WHOLE_NUMBERS = ("population", "latest_median_house_price", "crime_count")

# Acklam's rational approximation of the inverse normal distribution.
_TAIL = 0.02425
_CENTRE_NUM = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
_CENTRE_DEN = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_TAIL_NUM = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

# Abramowitz and Stegun 26.2.17, the normal distribution function.
_CDF = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0)
_CDF_SCALE = 0.2316419


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(x: Column) -> Column:
    def upper_tail(z: Column) -> Column:
        t = 1 / (1 + F.lit(_CDF_SCALE) * z)
        return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * _horner(t, _CDF)
    tail = upper_tail(F.abs(x))
    return F.when(x < 0, tail).otherwise(1 - tail)


def normal_quantile(p: Column) -> Column:
    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.log(q))
        return _horner(r, _TAIL_NUM) / _horner(r, _TAIL_DEN)
    c = p - 0.5
    r = c * c
    centre = c * _horner(r, _CENTRE_NUM) / _horner(r, _CENTRE_DEN)
    return F.when(p < _TAIL, tail(p)).when(p > 1 - _TAIL, -tail(1 - p)).otherwise(centre)


def _cdf(x: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of arrays."""
    z = np.abs(x)
    t = 1 / (1 + _CDF_SCALE * z)
    tail = np.exp(-z * z / 2) * 0.3989422804014327 * np.polyval(_CDF, t)
    return np.where(x < 0, tail, 1 - tail)


def _quantile(p: np.ndarray) -> np.ndarray:
    """``normal_quantile`` of arrays."""
    c = p - 0.5
    r = c * c
    centre = c * np.polyval(_CENTRE_NUM, r) / np.polyval(_CENTRE_DEN, r)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    tail = np.polyval(_TAIL_NUM, t) / np.polyval(_TAIL_DEN, t)
    return np.where(p < _TAIL, tail, np.where(p > 1 - _TAIL, -tail, centre))


def truncated_normal(mean: np.ndarray, sd: np.ndarray, u: np.ndarray, low: float | None) -> np.ndarray:
    """Draws above ``low`` for uniform ``u``; a mean at or below ``low`` gives ``low``."""
    if low is None:
        return mean + sd * _quantile(u)
    spread = np.where(sd > 0, sd, 1.0)
    below = _cdf((low - mean) / spread)
    share = np.minimum(below + u * (1 - below), 1 - 1e-12)
    value = np.maximum(low, mean + spread * _quantile(share))
    return np.where(mean <= low, low, np.where(sd <= 0, mean, value))


def imputable_columns(df: DataFrame) -> list[str]:
    """Columns that the catalogue marks for imputation, sorted."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    named = [c for c in IMPUTED_BY_NAME if c in numeric]
    return sorted({*named, *matching_columns(df, SERVICE_PREFIXES, SERVICE_METRICS)})


def _centred(array: pa.Array, centre: np.ndarray) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), len(centre)) - centre


def _sums(runs: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
    """Cross-product matrices as rows (run, cell, value)."""
    cells = parts[0].size if parts else 0
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.array(runs, np.int32), cells)), pa.array(np.tile(np.arange(cells, dtype=np.int32), len(parts))),
        pa.array(np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)),
    ], names=["run", "cell", "value"])


def _added(parts: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Matrices per run, added up over all tasks."""
    out: dict[int, np.ndarray] = {}
    for run, cell, value in parts.groupBy("run", "cell").agg(F.sum("value").alias("value")).collect():
        out.setdefault(run, np.zeros((size, size))).ravel()[cell] = value
    return out


def cross_products(df: DataFrame, cols: Sequence[str], centre: Sequence[float]) -> np.ndarray:
    """Sums of 1, x and x * x' over centred columns, of rows that have them all; one matrix per task is shuffled."""
    middle = np.array(centre)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(middle) + 1, len(middle) + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _centred(batch.column(0), middle)])
            total += x.T @ x
        yield _sums([0], [total])

    values = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    size = len(middle) + 1
    return _added(values.mapInArrow(partial, "run int, cell int, value double"), size).get(0, np.zeros((size, size)))


def _ridge(cross: np.ndarray, target: int):
    """Bayesian ridge regression from cross products alone.

    Evidence maximisation (MacKay 1992, Tipping 2001) with flat gamma priors on
    both precisions. Returns intercept, coefficients, their covariance, the
    predictor means and the noise variance.
    """
    others = [i for i in range(1, len(cross)) if i != target]
    n = cross[0, 0]
    mean = cross[0] / n
    xx = cross[np.ix_(others, others)] - n * np.outer(mean[others], mean[others])
    xy = cross[others, target] - n * mean[others] * mean[target]
    yy = max(cross[target, target] - n * mean[target] ** 2, 0.0)
    eig, basis = np.linalg.eigh(xx)
    eig = np.maximum(eig, 0.0)
    along = basis.T @ xy
    prior, tiny = 1e-6, np.finfo(float).eps
    noise, shrink, weights = 1.0 / (yy / n + tiny), 1.0, None
    for _ in range(300):
        solved = basis @ (along / (eig + shrink / noise))
        if weights is not None and np.abs(solved - weights).sum() < 1e-3:
            weights = solved
            break
        weights = solved
        fitted = (noise * eig / (shrink + noise * eig)).sum()
        error = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        shrink = (fitted + 2 * prior) / (weights @ weights + 2 * prior)
        noise = (n - fitted + 2 * prior) / (error + 2 * prior)
    cov = (basis / (noise * eig + shrink)) @ basis.T
    return mean[target] - weights @ mean[others], weights, cov, mean[others], 1.0 / noise


@dataclass(frozen=True)
class _Visit:
    """What the draws of one visit follow: the regression of ``target`` on all other columns, per run."""

    target: int
    place: tuple[int, ...]
    low: float | None
    start: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    factors: np.ndarray
    noise: np.ndarray

    @staticmethod
    def of(target: int, place: tuple[int, ...], low: float | None, models: Sequence[tuple]) -> _Visit:
        start, weights, covariance, middle, noise = (np.array([m[i] for m in models]) for i in range(5))
        # the variance of a mean is |L' (x - middle)|**2, with L L' the covariance of the weights
        factors = np.array([np.linalg.cholesky(c + 1e-18 * np.eye(len(c))) for c in covariance])
        return _Visit(target, place, low, start, weights, middle, factors, noise)

    def draw(self, x: np.ndarray, gaps: np.ndarray, runs: np.ndarray, hashes: np.ndarray) -> None:
        """Fill the gaps of the target, in place; ``x`` is centred."""
        others = np.delete(np.arange(x.shape[1]), self.target)
        for run in np.unique(runs):
            mine = np.flatnonzero(gaps[:, self.target] & (runs == run))
            if not len(mine):
                continue
            given = x[np.ix_(mine, others)]
            mean = self.start[run] + given @ self.weights[run]
            sd = np.sqrt(self.noise[run] + (((given - self.middle[run]) @ self.factors[run]) ** 2).sum(axis=1))
            x[mine, self.target] = truncated_normal(mean, sd, uniform(hashes[mine], *self.place, int(run)), self.low)


_STATE = "__id long, imputation_run int, h long, gaps array<boolean>, x array<double>"


def _replayed(batch: pa.RecordBatch, centre: np.ndarray, visits: Sequence[_Visit]):
    """(centred values, gaps, runs) of a batch of the state, after the visits."""
    x = _centred(batch.column(4), centre)
    gaps = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(x.shape)
    runs, hashes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    for visit in visits:
        visit.draw(x, gaps, runs, hashes)
    return x, gaps, runs


def _observed(state: DataFrame, centre: np.ndarray, visits: Sequence[_Visit], target: int) -> dict[int, np.ndarray]:
    """Cross products per run of the state's rows that have the target, after the visits since it was stored."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, gaps, runs = _replayed(batch, centre, visits)
            for run in np.unique(runs):
                mine = x[(runs == run) & ~gaps[:, target]]
                with_one = np.column_stack([np.ones(len(mine)), mine])
                total[run] = total.get(run, 0.0) + with_one.T @ with_one
        yield _sums(list(total), list(total.values()))

    return _added(state.mapInArrow(partial, "run int, cell int, value double"), len(centre) + 1)


def _after(state: DataFrame, centre: np.ndarray, visits: Sequence[_Visit]) -> DataFrame:
    """The state with the draws of the visits."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _replayed(batch, centre, visits)[0] + centre
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            drawn = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], drawn], names=["__id", "imputation_run", "h", "gaps", "x"])

    return state.mapInArrow(apply, _STATE)


def impute_chained(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], runs: int = 5, sweeps: int = 10,
    min_value: float | Mapping[str, float] | None = 0.0,
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
    whole: Sequence[str] = (), seed: int = 0,
) -> DataFrame:
    """Fill gaps ``runs`` times; the result has one row per input row and ``imputation_run``.

    Gaps start at the column mean. In each sweep the columns with gaps are
    visited from the fewest gaps to the most: the column is regressed on all
    others where it was observed, and its gaps are drawn from the predictive
    distribution above ``min_value``. Draws depend on key, column, sweep, run
    and seed, not on partitions. Columns without any value stay as they are.
    ``bounds`` and rounding (``whole``) apply to every row at the end.
    """
    base = df.withColumns({c: F.col(c).cast("double") for c in cols})
    facts = base.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.count_if(F.col(c).isNull()).alias(f"g_{c}") for c in cols],
    ).first()
    cols = [c for c in cols if facts[f"m_{c}"] is not None]
    centre = {c: facts[f"m_{c}"] for c in cols}
    visits = sorted([c for c in cols if facts[f"g_{c}"]], key=lambda c: (facts[f"g_{c}"], cols.index(c)))
    run_ids = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))

    gap = F.exists(F.array(*[F.col(c) for c in cols]), lambda v: v.isNull()) if cols else F.lit(False)
    # tied to the partition, so that the planner takes it as it is: what it derives from a condition on
    # many columns doubles with each column that is renamed or converted
    marked = base.withColumn("__open", F.when(F.spark_partition_id() >= 0, gap))
    full = marked.where("NOT __open").drop("__open")
    result = full.withColumn("imputation_run", run_ids)
    if visits and len(cols) > 1:
        middle = np.array([centre[c] for c in cols])
        fixed = cross_products(full, cols, middle)
        # numbered and stored once; what is visited holds the imputed columns only
        rows = checkpointed(marked.where("__open").drop("__open").withColumn("__id", F.monotonically_increasing_id()))
        # Visited many times over, so the rows are spread evenly first.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        state = checkpointed(rows.withColumn("imputation_run", run_ids).select(
            "__id", "imputation_run", F.xxhash64(*[F.col(k) for k in key]).alias("h"),
            F.array(*[F.col(c).isNull() for c in cols]).alias("gaps"),
            F.array(*[F.coalesce(F.col(c), F.lit(centre[c])) for c in cols]).alias("x"),
        ).repartition(tasks, "__id", "imputation_run"))
        lows = {c: min_value.get(c) if isinstance(min_value, Mapping) else min_value for c in visits}
        for sweep in range(sweeps):
            made: list[_Visit] = []
            for c in visits:
                target = cols.index(c)
                part = _observed(state, middle, made, target)
                models = [_ridge(fixed + part.get(r, 0.0), target + 1) for r in range(runs)]
                low = None if lows[c] is None else lows[c] - centre[c]
                made.append(_Visit.of(target, (seed, sweep, target), low, models))
            state = checkpointed(_after(state, middle, made))
        filled = state.select("__id", "imputation_run", "x")
        done = rows.join(filled, "__id").withColumns({c: F.coalesce(F.col(c), F.col("x")[cols.index(c)]) for c in visits})
        result = result.unionByName(done.select(*result.columns))
    elif visits:
        only = visits[0]
        result = base.withColumn("imputation_run", run_ids).withColumn(only, F.coalesce(only, F.lit(centre[only])))
    for c, (lo, hi) in (bounds or {}).items():
        if c in result.columns:
            result = result.withColumn(c, clip_to(c, lo, hi))
    return result.withColumns({c: F.bround(c, 0) for c in whole if c in result.columns})


def mean_over_runs(df: DataFrame, key: Sequence[str], run: str = "imputation_run", whole: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column over the runs."""
    cols = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in (*key, run)
    ]
    means = {c: F.bround(F.avg(c), 0) if c in whole else F.avg(c) for c in cols}
    return df.groupBy(*key).agg(*[m.alias(c) for c, m in means.items()])


def impute_regression(
    df: DataFrame, target: str, predictor: str, min_value: float | None = 0.0
) -> DataFrame:
    """Fill gaps of ``target`` from its least-squares line on ``predictor``; no draw."""
    line = df.agg(F.struct(
        F.regr_slope(target, predictor).alias("b"), F.regr_intercept(target, predictor).alias("a")
    )).scalar()
    fitted = F.col("__line.a") + F.col("__line.b") * F.col(predictor)
    if min_value is not None:
        fitted = clip_to(fitted, min_value)
    return df.withColumn("__line", line).withColumn(target, F.coalesce(F.col(target), fitted)).drop("__line")
