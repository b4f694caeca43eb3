"""How much the ranking depends on weights and on the way scores are combined."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.clean import row_mean
from areaindex.operators.ordering import average_rank, average_ranks, with_position
from areaindex.session import checkpointed


def alternative_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Equal-weight mean and geometric mean of ``value + 1``, less 1.

    Missing values are passed over by both; the geometric mean still takes the
    root of the full number of columns.
    """
    logs = reduce(add, [F.coalesce(F.log1p(F.col(c)), F.lit(0.0)) for c in cols])
    return df.withColumns({
        "equal_score": row_mean(cols),
        "geometric_score": F.expm1(logs / F.lit(float(len(cols)))),
    })


def join_baseline(scores: DataFrame, baseline: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scores of the areas that a published baseline has too."""
    return scores.join(baseline, list(key))


def rank_shift(df: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """Pearson r, Spearman rho and mean rank shift of each score against ``base``."""
    ranked = average_ranks(checkpointed(df.select(base, *others)), [base, *others], "__rank_")
    base_rank = F.col(f"__rank_{base}")
    stats = ranked.agg(*[
        F.struct(
            F.lit(c).alias("scenario"), F.corr(base, c).alias("pearson_r"),
            F.corr(base_rank, F.col(f"__rank_{c}")).alias("spearman_rho"),
            F.avg(F.abs(base_rank - F.col(f"__rank_{c}"))).alias("mean_rank_shift"),
        ).alias(c) for c in others
    ])
    return stats.select(F.explode(F.array(*[F.col(c) for c in others])).alias("s")).select("s.*")


def uniform_noise(seed: int = 42) -> Callable[[Column, int], Column]:
    """Uniform draws on (0, 1) that depend only on simulation, indicator and seed."""
    def draw(sim: Column, indicator: int) -> Column:
        bits = F.pmod(F.xxhash64(sim, F.lit(indicator), F.lit(seed)), F.lit(2 ** 52))
        return (bits.cast("double") + 0.5) / F.lit(float(2 ** 52))
    return draw


def simulated_ranks(
    df: DataFrame, key: str, weights: Mapping[str, float], sims: int = 100, spread: float = 0.2,
    seed: int = 42, noise: Callable[[Column, int], Column] | None = None,
) -> DataFrame:
    """Rank of every area in every simulation with weights moved by up to ``spread``."""
    draw = noise or uniform_noise(seed)
    sim = F.col("sim_id")
    cols = list(weights)
    moved = [F.lit(float(weights[c])) * (1 - spread + draw(sim, i) * (2 * spread)) for i, c in enumerate(cols)]
    scenarios = df.select(key, *cols).withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    score = reduce(add, [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in zip(cols, moved)
    ]) / reduce(add, moved)
    # Rounding makes equal scores equal whatever the order of the sums.
    scored = scenarios.select(key, "sim_id", F.round(score, 9).alias("score"))
    return average_rank(checkpointed(scored), "score", ["sim_id"], False, "rank").drop("score")


def weight_uncertainty(
    df: DataFrame, key: str, weights: Mapping[str, float], sims: int = 100, spread: float = 0.2,
    seed: int = 42, noise: Callable[[Column, int], Column] | None = None,
) -> DataFrame:
    """5th, 50th and 95th percentile of the simulated ranks of each area.

    A group holds one rank per simulation, so ``percentile`` stays small.
    """
    ranks = simulated_ranks(df, key, weights, sims, spread, seed, noise)
    levels = F.percentile("rank", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return ranks.groupBy(key).agg(levels.alias("q")).select(
        key, F.col("q")[0].alias("p05_rank"), F.col("q")[1].alias("median_rank"), F.col("q")[2].alias("p95_rank")
    )


def every_nth(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """Every n-th row in order, beginning with the first."""
    placed = with_position(df, [F.col(o) for o in order], (), "position")
    return placed.where((F.col("position") - 1) % n == 0)
