"""Weights from a rotated principal-component analysis, and the scores made with them.

Spark reads the data once for the correlation matrix. What follows has one row
or column per indicator and is solved with numpy on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The five pillars, in the order of the rotated components.
PILLAR_NAMES = (
    "Socio-Economic Deprivation",
    "Environmental Safety",
    "Secondary Education",
    "Primary Education",
    "Childcare Quality",
)

# The indicator scores behind each pillar.
PILLAR_SCORES = {
    "Socio-Economic": ("income_score", "employment_score", "crime_score"),
    "Primary Education": ("primary_read_score", "primary_math_score"),
    "Secondary Education": ("secondary_progress_score", "secondary_attainment_score"),
    "Environmental Safety": ("air_quality_no2_score", "air_quality_pm25_score"),
    "Childcare Quality": ("childcare_quality_score",),
}

# Raw indicators for which a high value is bad.
NEGATIVE_INDICATORS = (
    "crime_rate_per_1000",
    "no2_mean_concentration",
    "pm25_mean_concentration",
    "Income_Rate",
    "Employment_Rate",
)


@dataclass(frozen=True)
class PcaResult:
    """Principal components of standardised indicators."""

    cols: tuple[str, ...]
    rows: int
    means: np.ndarray
    sds: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray

    def loadings(self, k: int) -> np.ndarray:
        k = min(k, len(self.cols))
        return self.vectors[:, :k] * np.sqrt(np.maximum(self.eigenvalues[:k], 0.0))

    def kaiser_count(self) -> int:
        """Components that carry more variance than one indicator does."""
        return int((self.eigenvalues > 1.0).sum())

    def eigenvalue_table(self, spark: SparkSession) -> DataFrame:
        ratio = self.eigenvalues / self.eigenvalues.sum()
        total = np.cumsum(ratio)
        enough = int(np.argmax(total >= 0.8))
        rows = [
            (i + 1, float(self.eigenvalues[i]), float(ratio[i]), float(total[i]), bool(self.eigenvalues[i] > 1), i == enough)
            for i in range(len(self.cols))
        ]
        return spark.createDataFrame(
            rows, "component int, eigenvalue double, ratio double, cumulative double, kaiser boolean, reaches_80 boolean"
        )

    def scores(self, df: DataFrame, k: int, prefix: str = "PC") -> DataFrame:
        """Add the first ``k`` component scores to the rows that have every indicator."""
        whole = df.na.drop("any", subset=list(self.cols))
        return whole.withColumns({
            f"{prefix}{j + 1}": reduce(add, [
                (F.col(c) - float(self.means[i])) / float(self.sds[i] or 1.0) * float(self.vectors[i, j])
                for i, c in enumerate(self.cols)
            ]) for j in range(min(k, len(self.cols)))
        })


def pca(df: DataFrame, cols: Sequence[str]) -> PcaResult:
    """Component analysis over the rows that have every column.

    Variances use n - 1 on data standardised with n, so the eigenvalues add up
    to a little more than the number of indicators. Each component is signed so
    that its largest entry is positive.
    """
    whole = df.na.drop("any", subset=list(cols))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = whole.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    if n < 2:
        raise ValueError("component analysis needs at least two complete rows")
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    sds = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(sds > 0, sds, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(cols))]
    return PcaResult(
        tuple(cols), n, np.array([row[f"m{i}"] for i in range(len(cols))]), sds,
        values * n / (n - 1), vectors * np.where(largest < 0, -1.0, 1.0),
    )


def varimax(loadings: np.ndarray, sweeps: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Orthogonal rotation towards few large loadings per component (Kaiser 1958).

    The summed variance of the squared loadings is raised by rotating two
    components at a time in their plane, by the angle that is best for the two.
    Sweeps over all pairs go on until no angle exceeds ``tol``.
    """
    turned = np.array(loadings, dtype=float)
    rows, components = turned.shape
    for _ in range(sweeps):
        widest = 0.0
        for first, second in combinations(range(components), 2):
            x, y = turned[:, first].copy(), turned[:, second].copy()
            # in the plane of the pair, x + iy squared turns by twice the angle
            square = (x + 1j * y) ** 2
            moment = (square ** 2).sum() - square.sum() ** 2 / rows
            angle = np.angle(moment) / 4
            if abs(moment) < 1e-15 or abs(angle) <= tol:
                continue
            widest = max(widest, abs(angle))
            turned[:, first] = x * np.cos(angle) + y * np.sin(angle)
            turned[:, second] = y * np.cos(angle) - x * np.sin(angle)
        if widest <= tol:
            break
    return turned


def rotate(loadings: DataFrame) -> DataFrame:
    """Varimax rotation of a frame of loadings (ord, indicator, component, loading): one value per indicator and component."""
    rows = loadings.select("ord", "indicator", "component", "loading").orderBy("ord", "component").collect()
    components = sorted({r["component"] for r in rows})
    names = list(dict.fromkeys((r["ord"], r["indicator"]) for r in rows))
    value = {(r["ord"], r["component"]): r["loading"] for r in rows}
    turned = varimax(np.array([[value[o, c] for c in components] for o, _ in names]).reshape(len(names), len(components)))
    out = [(o, n, c, float(turned[i, j])) for i, (o, n) in enumerate(names) for j, c in enumerate(components)]
    return loadings.sparkSession.createDataFrame(out, "ord int, indicator string, component int, loading double")


def rotated_loadings(spark: SparkSession, result: PcaResult, k: int = 5) -> DataFrame:
    """One row per indicator and rotated component: ord, indicator, component, loading."""
    turned = varimax(result.loadings(k))
    rows = [
        (i, c, j + 1, float(turned[i, j]))
        for i, c in enumerate(result.cols) for j in range(turned.shape[1])
    ]
    return spark.createDataFrame(rows, "ord int, indicator string, component int, loading double")


def indicator_weights(loadings: DataFrame) -> DataFrame:
    """Two-level weights from rotated loadings.

    An indicator belongs to the component it loads on most (the first on a
    tie). Its weight there is its share of the squared loadings; the weight of
    a component is its share of the rotated variance over all indicators.
    """
    square = F.col("loading") ** 2
    components = loadings.groupBy("component").agg(F.sum(square).alias("component_variance"))
    components = components.withColumn(
        "component_weight", F.col("component_variance") / F.sum("component_variance").over(
            Window.partitionBy(F.lit(0)))
    )
    strongest = loadings.groupBy("ord", "indicator").agg(
        F.max_by(F.struct("component", "loading"), F.struct(F.abs("loading"), -F.col("component"))).alias("best")
    ).select("ord", "indicator", "best.*")
    within = Window.partitionBy("component")
    return (
        strongest.withColumn("squared", square)
        .withColumn("squared_total", F.sum("squared").over(within))
        .withColumn("weight", F.col("squared") / F.col("squared_total"))
        .join(components, "component")
        .withColumn("global_weight", F.col("weight") * F.col("component_weight"))
        .select(
            "component", "ord", "indicator", "loading", "squared", "squared_total", "weight",
            "component_variance", "component_weight", "global_weight",
        )
    )


def loading_report(loadings: DataFrame, k: int) -> DataFrame:
    """Loadings side by side, ordered by assigned component and indicator."""
    wide = loadings.groupBy("indicator").agg(
        F.max_by("component", F.struct(F.abs("loading"), -F.col("component"))).alias("assigned"),
        *[F.max(F.when(F.col("component") == j, F.col("loading"))).alias(f"RC{j}") for j in range(1, k + 1)],
    )
    return wide.orderBy("assigned", "indicator")


def weight_report(weights: DataFrame) -> DataFrame:
    """Weights per component with a total row, and whether each sums to one."""
    per_component = weights.groupBy("component").agg(
        F.sum("weight").alias("indicator_weights"), F.first("component_variance").alias("variance"),
        F.first("component_weight").alias("component_weight"), F.count(F.lit(1)).alias("indicators"),
    )
    total = per_component.agg(
        F.lit(None).cast("int").alias("component"), F.sum("indicator_weights").alias("indicator_weights"),
        F.sum("variance").alias("variance"), F.sum("component_weight").alias("component_weight"),
        F.sum("indicators").alias("indicators"),
    )
    sums = F.when(F.col("component").isNull(), F.abs(F.col("component_weight") - 1) < 1e-9).otherwise(
        F.abs(F.col("indicator_weights") - 1) < 1e-9
    )
    return per_component.unionByName(total).withColumn("sums_to_one", sums)


def composite(
    df: DataFrame, weights: DataFrame | Sequence[Mapping], names: Sequence[str] | str | None = None,
    out: str = "composite_score",
) -> DataFrame:
    """Pillar scores and the composite of them.

    ``weights`` needs component, indicator, weight and component_weight, one row
    per indicator. Pillars take ``names`` by position; ``"dominant"`` names each
    after its heaviest indicator. A component that no indicator belongs to has
    no pillar, and its weight is missing from the total, which is reported as
    ``weight_total``. A missing indicator makes the scores NULL. Column names
    ignore case, so an indicator named like a pillar moves to ``<name>_indicator``.
    """
    rows = [r.asDict() for r in weights.collect()] if isinstance(weights, DataFrame) else list(weights)
    rows.sort(key=lambda r: (r["component"], r.get("ord", 0)))
    pillars: dict[int, list] = {}
    for r in rows:
        pillars.setdefault(r["component"], []).append(r)

    def label(component: int) -> str:
        if names == "dominant":
            return max(pillars[component], key=lambda r: r["weight"])["indicator"] + "_pillar"
        if names and component <= len(names):
            return names[component - 1].replace(" ", "_") + "_Score"
        return f"RC{component}_score"

    scores = {
        f"__pillar{c}": reduce(add, [F.col(r["indicator"]) * F.lit(float(r["weight"])) for r in members])
        for c, members in pillars.items()
    }
    shares = {label(c): float(members[0]["component_weight"]) for c, members in pillars.items()}
    taken = {name.lower() for name in shares}
    aside = {c: f"{c}_indicator" for c in df.columns if c.lower() in taken}
    return (
        df.withColumns(scores).withColumnsRenamed(aside)
        .withColumnsRenamed({f"__pillar{c}": label(c) for c in pillars})
        .withColumn(out, reduce(add, [F.col(f"`{c}`") * F.lit(w) for c, w in shares.items()]))
        .withColumn("weight_total", F.lit(float(sum(shares.values()))))
    )


def cronbach_alpha(
    df: DataFrame, groups: Mapping[str, Sequence[str]], negate: Sequence[str] = NEGATIVE_INDICATORS
) -> DataFrame:
    """Internal consistency of each group of indicators, raw and standardised.

    Rows lacking any item of the group are left out. Bad-when-high items are
    turned round. Where no alpha exists (one item, no spread) it is 0. One pass
    over the data serves every group.
    """
    kept = {g: [c for c in cols if c in df.columns] for g, cols in groups.items()}
    stats = []
    for i, cols in enumerate(kept.values()):
        if len(cols) < 2:
            continue
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        signed = [F.when(whole, F.col(c) * (-1.0 if c in negate else 1.0)) for c in cols]
        stats += [F.var_samp(c).alias(f"v{i}_{j}") for j, c in enumerate(signed)]
        stats += [
            F.covar_samp(signed[j], signed[m]).alias(f"c{i}_{j}_{m}")
            for j in range(len(cols)) for m in range(j + 1, len(cols))
        ]
    one = df.agg(*stats) if stats else df.agg(F.count(F.lit(1)).alias("n"))

    def alpha(items, off_diagonal):
        k = F.lit(float(len(items)))
        spread, shared = reduce(add, items), reduce(add, off_diagonal)
        return k / (k - 1) * (1 - spread / F.nullif(spread + shared * 2, F.lit(0.0)))

    rows = []
    for i, (group, cols) in enumerate(kept.items()):
        raw = standard = F.lit(None).cast("double")
        if len(cols) > 1:
            pairs = [(j, m) for j in range(len(cols)) for m in range(j + 1, len(cols))]
            raw = alpha([F.col(f"v{i}_{j}") for j in range(len(cols))], [F.col(f"c{i}_{j}_{m}") for j, m in pairs])
            cor = [
                F.col(f"c{i}_{j}_{m}") / F.nullif(F.sqrt(F.col(f"v{i}_{j}") * F.col(f"v{i}_{m}")), F.lit(0.0))
                for j, m in pairs
            ]
            standard = alpha([F.lit(1.0)] * len(cols), cor)
        rows.append(F.struct(
            F.lit(group).alias("scale"), F.lit(len(cols)).alias("items"),
            F.coalesce(raw, F.lit(0.0)).alias("alpha_raw"), F.coalesce(standard, F.lit(0.0)).alias("alpha_std"),
        ))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
