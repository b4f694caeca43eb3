"""Scaling, weights, composite scores, robustness, imputation, area types."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaindex.functions import clean
from areaindex.operators import cluster, impute, normalise, robustness, weights
from areaindex.queries.base import METRICS, METRICS_SQL, area_metrics, hundredths, query, rounded, table
from areaindex.session import ensure_checkpoint_dir

# Score -> (indicator, whether a low value is good).
SPEC = {
    "balance_score": ("balance", False), "orders_score": ("order_count", True), "price_score": ("mean_price", False),
    "quantity_score": ("mean_quantity", False), "discount_score": ("mean_discount", True),
    "tax_score": ("mean_tax", True), "item_score": ("mean_item_price", False),
}
SCORES = tuple(SPEC)

# Two-level weights as a published table would give them: component, indicator, weight in it, component weight.
WEIGHTS = (
    (1, "balance_score", 0.6, 0.4), (1, "orders_score", 0.4, 0.4), (2, "price_score", 0.5, 0.35),
    (2, "quantity_score", 0.3, 0.35), (2, "item_score", 0.2, 0.35), (3, "discount_score", 0.7, 0.25),
    (3, "tax_score", 0.3, 0.25),
)
PILLARS = ("Custom Volume", "Trade Size", "Terms Given")
GLOBAL_WEIGHTS = {i: w * c for _, i, w, c in WEIGHTS}


def _score_sql(out: str, col: str, invert: bool) -> str:
    part = f"hi_{col} - c" if invert else f"c - lo_{col}"
    clipped = f"greatest(least({col}, hi_{col}), lo_{col})"
    return (
        f"CASE WHEN lo_{col} IS NULL OR lo_{col} = hi_{col} THEN 50.0::DOUBLE WHEN {col} IS NOT NULL THEN "
        f"CAST(round_even(({part.replace('c', clipped, 1) if part.startswith('c ') else part[:-1] + clipped}) "
        f"/ (hi_{col} - lo_{col}) * 100, 2) AS DOUBLE) END AS {out}"
    )


_BOUNDS_SQL = ", ".join(
    f"quantile_cont({c}, 0.025) AS lo_{c}, quantile_cont({c}, 0.975) AS hi_{c}" for c in METRICS
)
SCORES_SQL = f"""{METRICS_SQL},
bounds AS (SELECT {_BOUNDS_SQL} FROM metrics),
scores AS (SELECT area_code, mid_code, top_code, {", ".join(_score_sql(o, c, i) for o, (c, i) in SPEC.items())}
           FROM metrics, bounds)"""


def area_scores(spark, sf):
    scaled = normalise.winsor_minmax(area_metrics(spark, sf), SPEC)
    return scaled.select("area_code", "mid_code", "top_code", *SCORES)


@query("winsorised_scores", f"WITH {SCORES_SQL} SELECT area_code, {', '.join(SCORES)} FROM scores")
def winsorised_scores(spark, sf):
    return area_scores(spark, sf).select("area_code", *SCORES)


@query("winsorised_scores_by_region", f"""WITH {METRICS_SQL},
b AS (SELECT top_code, quantile_cont(balance, 0.025) AS lo, quantile_cont(balance, 0.975) AS hi FROM metrics GROUP BY 1)
SELECT area_code, CASE WHEN lo = hi THEN 50.0::DOUBLE ELSE
  CAST(round_even((greatest(least(balance, hi), lo) - lo) / (hi - lo) * 100, 2) AS DOUBLE) END AS balance_score
FROM metrics JOIN b USING (top_code)""")
def winsorised_scores_by_region(spark, sf):
    scaled = normalise.winsor_minmax(area_metrics(spark, sf), {"balance_score": ("balance", False)}, by=["top_code"])
    return scaled.select("area_code", "balance_score")


_COMPLETE_SQL = f"whole AS (SELECT * FROM metrics WHERE {' AND '.join(f'{c} IS NOT NULL' for c in METRICS)})"


@query("zscores", f"""WITH {METRICS_SQL}, {_COMPLETE_SQL},
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in METRICS)} FROM whole)
SELECT area_code, {", ".join(
    f"round(({c} - m_{c}) / d_{c}{' * -1' if c == 'mean_tax' else ''}, 6) + 0 AS {c}_z" for c in METRICS)} FROM whole, s""")
def zscores(spark, sf):
    found = normalise.zscore(area_metrics(spark, sf), METRICS, negate=["mean_tax"])
    cols = [f"{c}_z" for c in METRICS]
    plain = rounded(found.select("area_code", *cols), *cols)
    return plain.withColumns({c: F.col(c) + F.lit(0.0) for c in cols})


_GROUPS = {"size": ["mean_price", "mean_quantity", "mean_item_price"], "terms": ["mean_discount", "mean_tax"],
           "single": ["balance"]}


def _alpha_sql(group: str, cols: list[str]) -> str:
    if len(cols) < 2:
        return f"SELECT '{group}' AS scale, {len(cols)} AS items, 0.0::DOUBLE AS alpha_raw, 0.0::DOUBLE AS alpha_std"
    sign = {c: "-" if c == "mean_discount" else "" for c in cols}
    z = {c: f"({sign[c]}({c} - m_{c}) / d_{c})" for c in cols}
    total, ztotal = " + ".join(f"{sign[c]}{c}" for c in cols), " + ".join(z[c] for c in cols)
    k = len(cols)
    return f"""SELECT '{group}' AS scale, {k} AS items,
      {k} / ({k} - 1.0::DOUBLE) * (1 - ({' + '.join(f'var_samp({c})' for c in cols)}) / var_samp({total})) AS alpha_raw,
      {k} / ({k} - 1.0::DOUBLE) * (1 - ({' + '.join(f'var_samp({z[c]})' for c in cols)}) / var_samp({ztotal})) AS alpha_std
      FROM whole, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}' for c in cols)} FROM whole)"""


@query("cronbach_alpha", f"""WITH {METRICS_SQL}, {_COMPLETE_SQL}
SELECT scale, items, round(alpha_raw, 6) AS alpha_raw, round(alpha_std, 6) AS alpha_std FROM (
{" UNION ALL ".join(_alpha_sql(g, c) for g, c in _GROUPS.items())})""")
def cronbach_alpha(spark, sf):
    found = weights.cronbach_alpha(area_metrics(spark, sf), _GROUPS, negate=["mean_discount"])
    return rounded(found, "alpha_raw", "alpha_std")


@query("pca_eigenvalues")
def pca_eigenvalues(spark, sf):
    return weights.pca(area_scores(spark, sf), SCORES).eigenvalue_table(spark)


def _rotated(spark, sf, k=5):
    return weights.rotated_loadings(spark, weights.pca(area_scores(spark, sf), SCORES), k)


@query("indicator_weights")
def indicator_weights(spark, sf):
    return weights.indicator_weights(_rotated(spark, sf))


@query("loading_report")
def loading_report(spark, sf):
    return weights.loading_report(_rotated(spark, sf), 5)


@query("weight_report")
def weight_report(spark, sf):
    return weights.weight_report(weights.indicator_weights(_rotated(spark, sf)))


_PAIRS = [(a, b) for i, a in enumerate(SCORES) for b in SCORES[i + 1:]]


@query("pca_invariants", f"""WITH {SCORES_SQL},
whole AS (SELECT * FROM scores WHERE {" AND ".join(f"{c} IS NOT NULL" for c in SCORES)}),
c AS (SELECT count(*) / (count(*) - 1.0::DOUBLE) AS f, {" + ".join(f"corr({a}, {b}) ** 2" for a, b in _PAIRS)} AS s FROM whole)
SELECT {len(SCORES)} AS components, round({len(SCORES)} * f, 6) AS trace, round(({len(SCORES)} + 2 * s) * f * f, 6) AS squares FROM c""")
def pca_invariants(spark, sf):
    """The sum of the eigenvalues and of their squares, which correlations give too."""
    found = pca_eigenvalues(spark, sf).agg(
        F.count("*").alias("components"), F.sum("eigenvalue").alias("trace"), F.sum(F.col("eigenvalue") ** 2).alias("squares")
    )
    return rounded(found, "trace", "squares")


_AXES = ("balance", "order_count", "mean_quantity")


def _correlation_loadings(spark, sf):
    """Loadings that SQL can make as well: correlations of the indicators with three of them."""
    cells = area_metrics(spark, sf).agg(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(m).alias("indicator"), F.lit(j + 1).alias("component"),
                 F.round(F.corr(m, a), 6).alias("loading"))
        for i, m in enumerate(METRICS) for j, a in enumerate(_AXES)
    ]).alias("cells"))
    return cells.select(F.inline("cells"))


_LOADINGS_SQL = f"""{METRICS_SQL},
loadings AS ({" UNION ALL ".join(
    f"SELECT {i} AS ord, '{m}' AS indicator, {j + 1} AS component, round(corr({m}, {a}), 6) AS loading FROM metrics"
    for i, m in enumerate(METRICS) for j, a in enumerate(_AXES))}),
components AS (SELECT component, sum(loading ** 2) AS variance FROM loadings GROUP BY 1),
strongest AS (
  SELECT * FROM loadings QUALIFY row_number() OVER (PARTITION BY ord ORDER BY abs(loading) DESC, component) = 1),
weights AS (
  SELECT component, ord, indicator, loading, loading ** 2 / sum(loading ** 2) OVER (PARTITION BY component) AS weight,
         variance / (SELECT sum(variance) FROM components) AS component_weight
  FROM strongest JOIN components USING (component))"""


@query("rotated_correlations", f"""WITH {_LOADINGS_SQL},
p AS (SELECT ord, indicator, max(loading) FILTER (WHERE component = 1) AS x, max(loading) FILTER (WHERE component = 2) AS y
      FROM loadings WHERE component <= 2 GROUP BY 1, 2),
s AS (SELECT *, x * x - y * y AS u, 2 * x * y AS v FROM p),
a AS (SELECT atan2(2 * sum(u * v) - 2 * sum(u) * sum(v) / count(*),
                   sum(u * u - v * v) - (sum(u) ** 2 - sum(v) ** 2) / count(*)) / 4 AS t FROM s)
SELECT ord, indicator, 1 AS component, round(x * cos(t) + y * sin(t), 6) AS loading FROM s, a
UNION ALL SELECT ord, indicator, 2, round(y * cos(t) - x * sin(t), 6) FROM s, a""")
def rotated_correlations(spark, sf):
    """Varimax of two components, whose best angle has a closed form."""
    return rounded(weights.rotate(_correlation_loadings(spark, sf).where("component <= 2")), "loading")


@query("weights_of_correlations", f"""WITH {_LOADINGS_SQL}
SELECT component, ord, indicator, loading, round(weight, 6) AS weight, round(component_weight, 6) AS component_weight,
       round(weight * component_weight, 6) AS global_weight FROM weights""")
def weights_of_correlations(spark, sf):
    found = weights.indicator_weights(_correlation_loadings(spark, sf))
    return rounded(
        found.select("component", "ord", "indicator", "loading", "weight", "component_weight", "global_weight"),
        "weight", "component_weight", "global_weight",
    )


@query("report_of_correlations", f"""WITH {_LOADINGS_SQL}
SELECT l.indicator, s.component AS assigned, {", ".join(
    f"max(CASE WHEN l.component = {j} THEN l.loading END) AS RC{j}" for j in (1, 2, 3))}
FROM loadings l JOIN strongest s ON l.ord = s.ord GROUP BY 1, 2""")
def report_of_correlations(spark, sf):
    return weights.loading_report(_correlation_loadings(spark, sf), 3)


@query("weight_report_of_correlations", f"""WITH {_LOADINGS_SQL},
r AS (SELECT component, round(component_weight, 6) AS component_weight, count(*) AS indicators FROM weights GROUP BY 1, 2, weights.component_weight)
SELECT component, component_weight, indicators, true AS whole FROM r
UNION ALL SELECT NULL, round(sum(cw), 6), sum(n)::BIGINT, abs(sum(cw) - 1) < 1e-9
FROM (SELECT component, max(component_weight) AS cw, count(*) AS n FROM weights GROUP BY 1)""")
def weight_report_of_correlations(spark, sf):
    report = weights.weight_report(weights.indicator_weights(_correlation_loadings(spark, sf)))
    return rounded(report.select("component", "component_weight", "indicators", F.col("sums_to_one").alias("whole")), "component_weight")


@query("composite_from_data")
def composite_from_data(spark, sf):
    scores = area_scores(spark, sf)
    table_ = weights.indicator_weights(weights.rotated_loadings(spark, weights.pca(scores, SCORES), 5))
    return weights.composite(scores, table_, names=weights.PILLAR_NAMES)


def _fixed_weights():
    return [dict(component=c, indicator=i, weight=w, component_weight=cw) for c, i, w, cw in WEIGHTS]


def _pillar_sql(component: int) -> str:
    return " + ".join(f"{i} * {w}::DOUBLE" for c, i, w, _ in WEIGHTS if c == component)


_SHARES = {c: cw for c, _, _, cw in WEIGHTS}
_NAMES = {c: PILLARS[c - 1].replace(" ", "_") + "_Score" for c in _SHARES}
COMPOSITE_SQL = f"""{SCORES_SQL},
pillars AS (SELECT *, {", ".join(f'{_pillar_sql(c)} AS {n}' for c, n in _NAMES.items())} FROM scores),
composite AS (SELECT *, {" + ".join(f'{_NAMES[c]} * {w}::DOUBLE' for c, w in _SHARES.items())} AS composite_score FROM pillars)"""


def composite_table(spark, sf):
    return weights.composite(area_scores(spark, sf), _fixed_weights(), names=PILLARS)


@query("composite_scores", f"""WITH {COMPOSITE_SQL}
SELECT area_code, {", ".join(f'round({n}, 6) AS {n}' for n in _NAMES.values())},
       round(composite_score, 6) AS composite_score, round({sum(_SHARES.values())}::DOUBLE, 6) AS weight_total FROM composite""")
def composite_scores(spark, sf):
    cols = [*_NAMES.values(), "composite_score", "weight_total"]
    return rounded(composite_table(spark, sf).select("area_code", *cols), *cols)


_ALTERNATIVES_SQL = f"""{COMPOSITE_SQL},
alternatives AS (SELECT area_code, round(composite_score, 9) AS composite_score,
  round(({" + ".join(f"coalesce({s}, 0)" for s in SCORES)}) / nullif({" + ".join(f"({s} IS NOT NULL)::INT" for s in SCORES)}, 0), 9) AS equal_score,
  round(pow({" * ".join(f"(coalesce({s}, 0) + 1)" for s in SCORES)}, 1.0::DOUBLE / {len(SCORES)}) - 1, 9) AS geometric_score
  FROM composite)"""


def _alternatives(spark, sf):
    found = robustness.alternative_scores(composite_table(spark, sf), SCORES)
    cols = ["composite_score", "equal_score", "geometric_score"]
    return rounded(found.select("area_code", *cols), *cols, digits=9)


@query("aggregation_alternatives", f"""WITH {_ALTERNATIVES_SQL}
SELECT area_code, round(composite_score, 6) AS composite_score, round(equal_score, 6) AS equal_score,
       round(geometric_score, 6) AS geometric_score FROM alternatives""")
def aggregation_alternatives(spark, sf):
    return rounded(_alternatives(spark, sf), "composite_score", "equal_score", "geometric_score")


def _shift_sql(c: str) -> str:
    return f"""SELECT '{c}' AS scenario, corr(composite_score, {c}) AS pearson_r, corr(r_composite_score, r_{c}) AS spearman_rho,
      avg(abs(r_composite_score - r_{c})) AS mean_rank_shift FROM ranked"""


_RANKED_SQL = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE END AS r_{c}"
    for c in ("composite_score", "equal_score", "geometric_score")
)


@query("rank_shift", f"""WITH {_ALTERNATIVES_SQL}, ranked AS (SELECT *, {_RANKED_SQL} FROM alternatives)
SELECT scenario, round(pearson_r, 6) AS pearson_r, round(spearman_rho, 6) AS spearman_rho,
       round(mean_rank_shift, 6) AS mean_rank_shift
FROM ({_shift_sql("equal_score")} UNION ALL {_shift_sql("geometric_score")})""")
def rank_shift(spark, sf):
    found = robustness.rank_shift(_alternatives(spark, sf), "composite_score", ["equal_score", "geometric_score"])
    return rounded(found, "pearson_r", "spearman_rho", "mean_rank_shift")


_NOISE_SQL = [f"(0.8 + ((sim_id * 7919 + {i} * 104729) % 10007) / 10007.0::DOUBLE * 0.4)" for i in range(len(WEIGHTS))]
_MOVED_SQL = [f"({GLOBAL_WEIGHTS[s]!r}::DOUBLE * {n})" for s, n in zip(GLOBAL_WEIGHTS, _NOISE_SQL)]


def _arithmetic_noise(sim, i):
    return ((sim.cast("long") * 7919 + i * 104729) % 10007) / F.lit(10007.0)


@query("weight_uncertainty", f"""WITH {SCORES_SQL},
runs AS (SELECT area_code, sim_id, round(({" + ".join(f"coalesce({s}, 0) * {m}" for s, m in zip(GLOBAL_WEIGHTS, _MOVED_SQL))})
  / ({" + ".join(_MOVED_SQL)}), 9) AS score FROM scores, (SELECT unnest(range(100)) AS sim_id)),
ranks AS (SELECT area_code, rank() OVER (PARTITION BY sim_id ORDER BY score DESC)
  + (count(*) OVER (PARTITION BY sim_id, score) - 1) / 2.0::DOUBLE AS r FROM runs)
SELECT area_code, round(quantile_cont(r, 0.05), 6) AS p05_rank, round(quantile_cont(r, 0.5), 6) AS median_rank,
       round(quantile_cont(r, 0.95), 6) AS p95_rank FROM ranks GROUP BY 1""")
def weight_uncertainty(spark, sf):
    found = robustness.weight_uncertainty(
        area_scores(spark, sf), "area_code", GLOBAL_WEIGHTS, noise=_arithmetic_noise
    )
    return rounded(found, "p05_rank", "median_rank", "p95_rank")


@query("every_tenth_area", f"""WITH {COMPOSITE_SQL},
p AS (SELECT area_code, composite_score, row_number() OVER (ORDER BY round(composite_score, 6) NULLS FIRST, area_code) AS position FROM composite)
SELECT area_code, CAST(position AS INT) AS position FROM p WHERE position % 10 = 1""")
def every_tenth_area(spark, sf):
    scored = rounded(composite_table(spark, sf).select("area_code", "composite_score"), "composite_score")
    return robustness.every_nth(scored, ["composite_score", "area_code"], 10).select("area_code", "position")


def _gappy(spark, sf):
    key = F.col("area_code")
    return area_metrics(spark, sf).select(
        "area_code", F.lit(2024).alias("year"), "balance", "mean_price",
        F.when(key % 7 != 0, F.col("order_count")).alias("order_count"),
        F.when(key % 5 != 1, F.col("mean_quantity")).alias("mean_quantity"),
        F.when(key % 11 != 2, F.col("mean_item_price")).alias("mean_item_price"),
    )


_IMPUTED = ["balance", "mean_price", "order_count", "mean_quantity", "mean_item_price"]


@query("impute_chained")
def impute_chained(spark, sf):
    ensure_checkpoint_dir(spark)
    return impute.impute_chained(
        _gappy(spark, sf), ["area_code", "year"], _IMPUTED, min_value={"order_count": 0.0, "mean_quantity": 0.0,
        "mean_item_price": 0.0}, bounds={"mean_quantity": (1.0, 50.0)}, whole=["order_count"],
    )


_CHOSEN = ("mean_price", "mean_quantity")


@query("columns_by_pattern", f"""WITH {METRICS_SQL}
{" UNION ALL ".join(f"SELECT '{c}' AS indicator, count({c}) AS present, round(sum({c}), 2) AS total FROM metrics" for c in _CHOSEN)}""")
def columns_by_pattern(spark, sf):
    """Numeric columns named after means of prices or quantities, those of single items left out, that hold a value."""
    metrics = area_metrics(spark, sf).withColumn("mean_price_text", F.col("mean_price").cast("string"))
    empty = metrics.withColumn("mean_quantity_planned", F.lit(None).cast("double"))
    named = clean.matching_columns(empty, ["mean_"], ["price", "quantity"], without=["item"])
    held = clean.non_empty_columns(empty, named)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("value")) for c in held]))
    return empty.select(cells).groupBy("indicator").agg(
        F.count("value").alias("present"), F.round(F.sum("value"), 2).alias("total")
    )


_FILLED = ("order_count", "mean_quantity", "mean_item_price")
_MASKS = {"order_count": "area_code % 7 <> 0", "mean_quantity": "area_code % 5 <> 1", "mean_item_price": "area_code % 11 <> 2"}


@query("impute_invariants", f"""WITH {METRICS_SQL},
g AS (SELECT area_code, {", ".join(f"CASE WHEN {m} THEN {c} END AS {c}" for c, m in _MASKS.items())} FROM metrics),
one AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS indicator, count(*) - count({c}) AS filled, round(sum({c}), 2) AS observed FROM g" for c in _FILLED)})
SELECT run AS imputation_run, indicator, filled, observed, 0 AS missing, 0 AS outside FROM one, range(5) r(run)""")
def impute_invariants(spark, sf):
    """Per run and indicator: values filled, sum of those observed, values missing or out of bounds after all."""
    gaps = _gappy(spark, sf).select("area_code", *[F.col(c).isNotNull().alias(f"had_{c}") for c in _FILLED])
    done = impute_chained(spark, sf).join(gaps, "area_code")
    floor = {"order_count": 0.0, "mean_quantity": 1.0, "mean_item_price": 0.0}
    cells = F.inline(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).alias("value"), F.col(f"had_{c}").alias("had"), F.lit(floor[c]).alias("low"))
        for c in _FILLED
    ]))
    return done.select("imputation_run", cells).groupBy("imputation_run", "indicator").agg(
        F.count_if(~F.col("had")).alias("filled"), F.round(F.sum(F.when(F.col("had"), F.col("value"))), 2).alias("observed"),
        F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") < F.col("low")).alias("outside"),
    )


@query("imputed_mean_over_runs")
def imputed_mean_over_runs(spark, sf):
    return impute.mean_over_runs(impute_chained(spark, sf), ["area_code", "year"], whole=["order_count"])


@query("mean_of_runs", """WITH runs AS (
  SELECT l_suppkey AS area_code, CAST(year(l_shipdate) AS INT) AS year, l_linenumber AS imputation_run, count(*) AS items,
         CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS quantity,
         CAST(max(CASE WHEN l_tax > 0.04 THEN round(l_extendedprice * 100) END) AS BIGINT) AS dearest FROM lineitem GROUP BY 1, 2, 3)
SELECT area_code, year, round_even(avg(items), 0) AS items, round(avg(quantity), 6) AS quantity, round(avg(dearest), 6) AS dearest
FROM runs GROUP BY 1, 2""")
def mean_of_runs(spark, sf):
    """Means over runs that are line numbers, so that each is known; NULLs are left out."""
    runs = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("area_code"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("imputation_run")
    ).agg(
        F.count("*").alias("items"), F.sum(hundredths("l_quantity")).alias("quantity"),
        F.max(F.when(F.col("l_tax") > 0.04, hundredths("l_extendedprice"))).alias("dearest"),
    )
    return rounded(impute.mean_over_runs(runs, ["area_code", "year"], whole=["items"]), "quantity", "dearest")


@query("impute_regression", f"""WITH {METRICS_SQL},
g AS (SELECT area_code, CASE WHEN area_code % 5 <> 1 THEN mean_quantity END AS q, mean_item_price AS x FROM metrics),
l AS (SELECT regr_slope(q, x) AS b, regr_intercept(q, x) AS a FROM g)
SELECT area_code, round(coalesce(q, CASE WHEN x IS NOT NULL THEN greatest(a + b * x, 0) END), 6) AS mean_quantity FROM g, l""")
def impute_regression(spark, sf):
    gappy = area_metrics(spark, sf).select(
        "area_code", F.when(F.col("area_code") % 5 != 1, F.col("mean_quantity")).alias("mean_quantity"), "mean_item_price"
    )
    found = impute.impute_regression(gappy, "mean_quantity", "mean_item_price")
    return rounded(found.select("area_code", "mean_quantity"), "mean_quantity")


@query("tandem_clusters")
def tandem_clusters(spark, sf):
    return cluster.tandem_clusters(area_scores(spark, sf), SCORES, k=5).select("area_code", "cluster", "PC1", "PC2")


_VECTOR_PILLARS = {f"Block {b + 1}": [f"e{i}" for i in range(b * 16, b * 16 + 16)] for b in range(4)}


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("cluster"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
    )


_BLOCKS_SQL = """v AS (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) // 16 AS b FROM embeddings),
p AS (SELECT label, b, avg(x) AS m FROM v GROUP BY 1, 2),
r AS (SELECT *, (m - min(m) OVER (PARTITION BY b)) / (max(m) OVER (PARTITION BY b) - min(m) OVER (PARTITION BY b)) AS z FROM p)"""


@query("cluster_profiles", f"""WITH {_BLOCKS_SQL},
t AS (SELECT label, string_agg('Block ' || (b + 1), ', ' ORDER BY b) FILTER (WHERE z >= 0.66) AS hi,
             string_agg('Block ' || (b + 1), ', ' ORDER BY b) FILTER (WHERE z <= 0.33) AS lo FROM r GROUP BY 1),
s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1)
SELECT label AS cluster, size, round(size * 100.0::DOUBLE / (SELECT sum(size) FROM s), 6) AS share_pct,
  CASE WHEN hi IS NULL AND lo IS NULL THEN 'Profile: Average/Mixed performance.'
       WHEN lo IS NULL THEN 'Strengths: ' || hi WHEN hi IS NULL THEN 'Challenges: ' || lo
       ELSE 'Strengths: ' || hi || '; Challenges: ' || lo END AS description
FROM t JOIN s USING (label)""")
def cluster_profiles(spark, sf):
    found = cluster.cluster_profiles(_vectors(spark, sf), _VECTOR_PILLARS)
    return rounded(found.select("cluster", "size", "share_pct", "description"), "share_pct")


@query("cluster_radar", f"""WITH {_BLOCKS_SQL}
SELECT label AS cluster, 'Block ' || (b + 1) AS pillar, round(m, 6) AS value FROM p""")
def cluster_radar(spark, sf):
    return rounded(cluster.radar_rows(_vectors(spark, sf), _VECTOR_PILLARS), "value")


@query("vector_clusters")
def vector_clusters(spark, sf):
    found = cluster.kmeans_labels(_vectors(spark, sf).drop("cluster"), [f"e{i}" for i in range(64)], k=6)
    return found.select("vec_id", "cluster")


_GROUP_SQL = "CASE WHEN c_custkey % 10 < 4 THEN 0 WHEN c_custkey % 10 < 7 THEN 1 WHEN c_custkey % 10 < 9 THEN 2 ELSE 3 END"


@query("separated_clusters", f"SELECT c_custkey AS area_code, {_GROUP_SQL} AS cluster FROM customer")
def separated_clusters(spark, sf):
    """Four far-off groups of areas, so that the labels follow from the keys."""
    group, key = F.expr(_GROUP_SQL), F.col("c_custkey")
    points = table(spark, sf, "customer").select(
        key.alias("area_code"), (group * 100 + (key * 7919 % 10007) / 10007).alias("x"),
        (group % 2 * 100 + (key * 104729 % 10009) / 10009).alias("y"),
    )
    return cluster.kmeans_labels(points, ["x", "y"], 4).select("area_code", "cluster")
