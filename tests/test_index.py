"""Weights, robustness, imputation and area types."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from areaindex.operators import cluster, impute, normalise, robustness, weights

COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 2))
    noise = rng.normal(size=(300, 5))
    x = np.column_stack([base[:, 0], base[:, 0], base[:, 1], base[:, 1], base[:, 0] - base[:, 1]]) + .5 * noise
    pdf = pd.DataFrame(np.round(50 + 10 * x, 4), columns=COLS)
    pdf.insert(0, "id", range(300))
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame([tuple(map(float, r)) for r in frame.to_numpy()], ", ".join(f"{c} double" for c in frame))


def test_pca_matches_numpy(df, frame):
    got = weights.pca(df, COLS)
    x = frame[COLS].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(got.eigenvalues, values)
    assert got.kaiser_count() == int((values > 1).sum())
    scores = got.scores(df, 2).select("PC1", "PC2").toPandas().to_numpy()
    assert np.allclose(scores.var(axis=0, ddof=1), values[:2])
    assert np.allclose(got.loadings(5) @ got.loadings(5).T, np.cov(z.T))


def test_varimax_keeps_communalities_and_raises_the_criterion(df):
    raw = weights.pca(df, COLS).loadings(3)
    short = weights.varimax(raw)
    turned = weights.varimax(raw, sweeps=2000, tol=1e-13)
    assert np.allclose((raw ** 2).sum(1), (short ** 2).sum(1))
    assert np.allclose((raw ** 2).sum(1), (turned ** 2).sum(1))
    spread = lambda m: (m ** 2).var(axis=0).sum()
    assert spread(turned) >= spread(short) - 1e-12 >= spread(raw) - 2e-12
    # No plane rotation of two components improves it further.
    for i in range(3):
        for j in range(i + 1, 3):
            for t in (-.02, .02):
                turn = np.eye(3)
                turn[[i, i, j, j], [i, j, i, j]] = [np.cos(t), -np.sin(t), np.sin(t), np.cos(t)]
                assert spread(turned @ turn) <= spread(turned) + 1e-6


def test_two_level_weights(spark, df):
    loadings = weights.rotated_loadings(spark, weights.pca(df, COLS), 3)
    table = weights.indicator_weights(loadings).toPandas()
    long = loadings.toPandas().pivot(index="indicator", columns="component", values="loading").loc[COLS]
    home = long.abs().idxmax(axis=1)
    total = (long ** 2).to_numpy().sum()
    for r in table.itertuples():
        assert r.component == home[r.indicator]
        mates = [i for i in COLS if home[i] == r.component]
        assert r.weight == pytest.approx(long.loc[r.indicator, r.component] ** 2 / (long.loc[mates, r.component] ** 2).sum())
        assert r.component_weight == pytest.approx((long[r.component] ** 2).sum() / total)
    report = weights.weight_report(weights.indicator_weights(loadings)).collect()
    used = table.component.nunique()
    assert len(report) == used + 1
    assert all(r["sums_to_one"] for r in report if r["component"] is not None)
    assert [r["sums_to_one"] for r in report if r["component"] is None] == [used == 3]


def test_ties_go_to_the_first_component(spark):
    rows = [(0, "x", 1, .5), (0, "x", 2, -.5), (1, "y", 1, .1), (1, "y", 2, .9)]
    loadings = spark.createDataFrame(rows, "ord int, indicator string, component int, loading double")
    assert {r["indicator"]: r["component"] for r in weights.indicator_weights(loadings).collect()} == {"x": 1, "y": 2}


def test_composite(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 30.0), (2, None, 20.0, 30.0)], "id int, x double, y double, z double")
    w = [dict(component=1, indicator="x", weight=.25, component_weight=.5), dict(component=1, indicator="y", weight=.75, component_weight=.5),
         dict(component=3, indicator="z", weight=1.0, component_weight=.3)]
    got = weights.composite(df, w, names=["First One", "Second", "Third"]).collect()
    assert (got[0]["First_One_Score"], got[0]["Third_Score"], got[0]["composite_score"], got[0]["weight_total"]) == (
        17.5, 30.0, pytest.approx(17.75), pytest.approx(.8))
    assert got[1]["First_One_Score"] is None and got[1]["composite_score"] is None and got[1]["Third_Score"] == 30.0
    assert "y_pillar" in weights.composite(df, w, names="dominant").columns


def test_cronbach(spark, df, frame):
    got = {r["scale"]: r for r in weights.cronbach_alpha(df, {"all": ["a", "b"], "one": ["c"], "gone": ["zz"]}, negate=["b"]).collect()}
    x = frame[["a", "b"]].to_numpy() * [1, -1]
    alpha = lambda v: v.shape[1] / (v.shape[1] - 1) * (1 - v.var(0, ddof=1).sum() / v.sum(1).var(ddof=1))
    assert got["all"]["alpha_raw"] == pytest.approx(alpha(x))
    assert got["all"]["alpha_std"] == pytest.approx(alpha((x - x.mean(0)) / x.std(0, ddof=1)))
    assert (got["one"]["alpha_raw"], got["gone"]["alpha_std"]) == (0.0, 0.0)


def test_zscore_is_population_sd_and_listwise(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (9.0, None)], "x double, flat double")
    got = sorted((r["x_z"], r["flat_z"]) for r in normalise.zscore(df, ["x", "flat"]).collect())
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_alternative_scores_and_rank_shift(spark, df, frame):
    got = robustness.alternative_scores(df, COLS).toPandas()
    assert np.allclose(got.equal_score, frame[COLS].mean(axis=1))
    assert np.allclose(got.geometric_score, (frame[COLS] + 1).prod(axis=1) ** (1 / 5) - 1)
    gap = spark.createDataFrame([(3.0, None), (None, None)], "x double, y double")
    first, second = robustness.alternative_scores(gap, ["x", "y"]).collect()
    assert (first["equal_score"], second["equal_score"]) == (3.0, None)
    assert first["geometric_score"] == pytest.approx(4 ** .5 - 1)
    row = robustness.rank_shift(robustness.alternative_scores(df, COLS), "equal_score", ["geometric_score"]).first()
    r1, r2 = got.equal_score.rank(ascending=False), got.geometric_score.rank(ascending=False)
    assert row["spearman_rho"] == pytest.approx(r1.corr(r2)) and row["mean_rank_shift"] == pytest.approx((r1 - r2).abs().mean())


def test_simulated_ranks(df):
    w = {c: 1 / 5 for c in COLS}
    ranks = robustness.simulated_ranks(df, "id", w, sims=7, seed=3)
    sums = ranks.groupBy("sim_id").agg(F.sum("rank").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 7 and all(r["s"] == 300 * 301 / 2 and r["n"] == 300 for r in sums)
    again = robustness.simulated_ranks(df.repartition(5), "id", w, sims=7, seed=3)
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, again.collect()))
    fixed = robustness.weight_uncertainty(df, "id", w, sims=7, spread=0.0).collect()
    assert all(r["p05_rank"] == r["median_rank"] == r["p95_rank"] for r in fixed)


def test_normal_distribution_columns(spark):
    from statistics import NormalDist

    ps = [1e-9, 1e-4, .02, .025, .3, .5, .77, .98, .9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", impute.normal_quantile(F.col("p")).alias("q"), impute.normal_cdf(impute.normal_quantile(F.col("p"))).alias("c")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-6, abs=1e-6)
        assert r["c"] == pytest.approx(r["p"], abs=1e-6)


@pytest.fixture(scope="module")
def gappy(spark, frame):
    pdf = frame[["id", "a", "b", "c"]].copy()
    pdf["y"] = 2 * pdf.a - pdf.c + np.random.default_rng(0).normal(size=len(pdf))
    pdf["empty"] = None
    pdf.loc[pdf.id % 4 == 1, "y"] = np.nan
    pdf.loc[pdf.id % 9 == 2, "b"] = np.nan
    rows = [tuple(None if v is None or v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id double, a double, b double, c double, y double, empty double"), frame


def test_imputation(gappy):
    df, frame = gappy
    cols = ["a", "b", "c", "y", "empty"]
    run = lambda d: impute.impute_chained(d, ["id"], cols, runs=3, sweeps=4, min_value=None)
    first = run(df).toPandas().sort_values(["imputation_run", "id"]).reset_index(drop=True)
    again = run(df.repartition(5)).toPandas().sort_values(["imputation_run", "id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(first, again[first.columns], rtol=1e-6)
    assert len(first) == 900 and first["empty"].isna().all() and first[["a", "b", "c", "y"]].notna().all().all()
    seen = df.toPandas()
    for r in range(3):
        one = first[first.imputation_run == r].set_index("id")
        kept = seen[seen.y.notna()].set_index("id")
        assert (one.loc[kept.index, "y"] == kept.y).all()
        gaps = seen[seen.y.isna()].set_index("id")
        error = one.loc[gaps.index, "y"] - (2 * gaps.a - gaps.c)
        # Noise of the data has sd 1; draws carry that noise, not more.
        assert abs(error.mean()) < .5 and .6 < error.std() < 1.5
    spread = first[first.id == 1.0].groupby("id").y.std().iloc[0]
    assert spread > 0
    pooled = impute.mean_over_runs(impute.impute_chained(df, ["id"], cols, runs=3, sweeps=4, min_value=None), ["id"]).toPandas()
    assert np.allclose(pooled.set_index("id").y.sort_index(), first.groupby("id").y.mean().sort_index())


def test_imputation_bounds(gappy):
    df, _ = gappy
    out = impute.impute_chained(
        df, ["id"], ["a", "b", "c", "y"], runs=2, sweeps=2, min_value={"y": 60.0}, bounds={"y": (None, 70.0)}, whole=["y"]
    ).toPandas()
    missing = set(df.where("y IS NULL").toPandas().id)
    y = out[out.id.isin(missing)].y
    assert y.min() >= 60 and y.max() <= 70 and (y == y.round()).all()


def test_ridge_agrees_with_least_squares():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, -2.0, .5] + 4 + .1 * rng.normal(size=500)
    full = np.column_stack([np.ones(500), x, y])
    start, coef, cov, mean, noise = impute._ridge(full.T @ full, 4)
    assert np.allclose(coef, [1, -2, .5], atol=.02) and start == pytest.approx(4, abs=.02)
    assert noise == pytest.approx(.01, rel=.2)
    centred = x - x.mean(0)
    assert np.allclose(cov, noise * np.linalg.inv(centred.T @ centred), rtol=.05)
    assert np.allclose(mean, x.mean(0))


def test_imputable_columns(spark):
    df = spark.createDataFrame([(1.0, 2, "x", 3.0, 4.0)], "IMD_Score double, gp_1_distance int, gp_1_name string, other double, primary_read_score_weighted double")
    assert impute.imputable_columns(df) == ["IMD_Score", "gp_1_distance", "primary_read_score_weighted"]


def test_clusters_are_found_and_numbered_by_size(spark):
    rng = np.random.default_rng(3)
    sizes, centres = [60, 30, 10], [(0, 0, 0), (20, 0, 5), (0, 30, -5)]
    rows = [(float(i * 100 + j), *map(float, rng.normal(size=3) + c)) for i, (n, c) in enumerate(zip(sizes, centres)) for j in range(n)]
    df = spark.createDataFrame(rows, "id double, x double, y double, z double")
    out = cluster.tandem_clusters(df, ["x", "y", "z"], k=3, components=2, inits=3).toPandas()
    assert out.groupby("cluster").size().to_dict() == {0: 60, 1: 30, 2: 10}
    assert out.groupby(out.id // 100).cluster.nunique().eq(1).all()
    means = cluster.cluster_means(cluster.tandem_clusters(df, ["x", "y", "z"], k=3, components=2, inits=3), ["x"]).collect()
    assert sum(r["share_pct"] for r in means) == pytest.approx(100)


def test_cluster_descriptions(spark):
    rows = [(0, 10.0, 5.0, 1.0), (0, 20.0, 5.0, 1.0), (1, 50.0, 5.0, 2.0), (2, 33.0, 5.0, 1.5)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double, c double")
    got = {r["cluster"]: r["description"] for r in cluster.cluster_profiles(df, {"A": ["a"], "B": ["b"], "C": ["c"]}).collect()}
    assert got == {0: "Challenges: A, C", 1: "Strengths: A, C", 2: "Profile: Average/Mixed performance."}


def test_kmeans_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((600, 2)))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    labels = [
        {r["id"]: r["cluster"] for r in cluster.kmeans_labels(df.repartition(n), ["x", "y"], 4, inits=3).collect()} for n in (1, 8)
    ]
    assert labels[0] == labels[1] and set(labels[0].values()) == {0, 1, 2, 3}
    sizes = [list(labels[0].values()).count(c) for c in range(4)]
    assert sizes == sorted(sizes, reverse=True)
    assert cluster.kmeans_labels(df.limit(0), ["x", "y"], 4).count() == 0
    same = spark.createDataFrame([(1, 2.0, 3.0)] * 5, "id int, x double, y double")
    assert {r["cluster"] for r in cluster.kmeans_labels(same, ["x", "y"], 3).collect()} == {0}


def test_kmeans_of_many_rows_over_few_distinct_vectors(spark):
    """20,000 rows over 20 places: every row has a label, and all of k groups are found."""
    rows = spark.range(20_000, numPartitions=4).selectExpr("id", "id % 4 * 100D + id % 20 DIV 4 AS x", "id % 4 % 2 * 100D AS y")
    out = cluster.kmeans_labels(rows, ["x", "y"], 4).groupBy((F.col("id") % 4).alias("g"), "cluster").count().collect()
    assert {r["count"] for r in out} == {5000} and {r["cluster"] for r in out} == {0, 1, 2, 3} and len(out) == 4


def test_kmeans_finds_a_small_far_off_group(spark):
    """3 of 40,000 rows lie off two wide groups; a centre of their own saves more than a third one in a wide group."""
    rows = spark.range(40_000, numPartitions=4).selectExpr(
        "id", "id >= 39997 AS far", "id * 7919 % 40009 / 40009D + IF(id >= 39997, 0, id % 2 * 100) AS x", "id * 104729 % 40013 / 40013D + IF(id >= 39997, 60, 0) AS y"
    )
    out = cluster.kmeans_labels(rows, ["x", "y"], 3).groupBy("far", "cluster").count().collect()
    assert {r["cluster"] for r in out if r["far"]} == {2} and {r["cluster"] for r in out if not r["far"]} == {0, 1}


def test_kmeans_starts_are_drawn_by_count_and_squared_distance(spark):
    places = spark.createDataFrame([([0.0], 1), ([3.0], 6), ([4.0], 3)], "__v array<double>, __n long")
    starts = cluster._starts(places.withColumn("__h", F.xxhash64("__v")), 4, 4000, 1)
    assert all(sorted(s.ravel()) == [0.0, 3.0, 4.0] for s in starts)
    first = [float(s[0, 0]) for s in starts]
    assert [np.mean([f == v for f in first]) for v in (0.0, 3.0, 4.0)] == pytest.approx([.1, .6, .3], abs=.03)
    after = [float(s[1, 0]) for s in starts if s[0, 0] == 3.0]  # 1 * 9 against 3 * 1
    assert np.mean([v == 0.0 for v in after]) == pytest.approx(.75, abs=.03)


def plain_lloyd(x, n, centres, rounds, still):
    """Every point compared in every round."""
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = centres.copy()
        for c in range(len(centres)):
            if n[near == c].sum():
                moved[c] = (x[near == c] * n[near == c, None]).sum(axis=0) / n[near == c].sum()
        if ((moved - centres) ** 2).sum() <= still:
            break
        centres = moved
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    return (near.min(axis=1) * n).sum(), np.bincount(near.argmin(axis=1), n, len(centres)), centres


@pytest.mark.parametrize("open_points", [0, 40, 400, 50_000])
def test_rounds_over_open_points_equal_rounds_over_all(spark, monkeypatch, open_points):
    monkeypatch.setattr(cluster, "OPEN_POINTS", open_points)
    passes = []
    passed = cluster._passed
    monkeypatch.setattr(cluster, "_passed", lambda *a: passes.append(1) or passed(*a))
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(400, 3)) + c for c in ([0, 0, 0], [3, 0, 0], [0, 4, 0], [9, 9, 9])])
    n = rng.integers(1, 4, len(x))
    features = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, n)], "__v array<double>, __n long").repartition(4).persist()
    starts = [x[rng.choice(len(x), 5, replace=False)] for _ in range(4)]
    got = cluster._lloyd(features, [s.copy() for s in starts], 300, 1e-9, 5.0)
    for (cost, sizes, centres), start in zip(got, starts):
        want = plain_lloyd(x, n.astype(float), start, 300, 1e-9)
        assert cost == pytest.approx(want[0]) and sizes.tolist() == want[1].tolist() and np.allclose(centres, want[2])
    assert len(passes) <= {0: 300, 40: 60, 400: 30, 50_000: 2}[open_points]
    short = cluster._lloyd(features, [starts[0].copy()], 2, 0.0, 5.0)[0]
    assert np.allclose(short[2], plain_lloyd(x, n.astype(float), starts[0], 1, 0.0)[2])
    features.unpersist()


def test_normal_functions_of_arrays_agree_with_columns(spark):
    p = np.r_[1e-9, .01, .02425, .3, .5, .97574, .98, 1 - 1e-9]
    rows = spark.createDataFrame([(float(v),) for v in p], "p double").select(
        impute.normal_quantile(F.col("p")).alias("q"), impute.normal_cdf(F.col("p") * 6 - 3).alias("c")
    ).collect()
    assert np.allclose([r.q for r in rows], impute._quantile(p), rtol=1e-12) and np.allclose([r.c for r in rows], impute._cdf(p * 6 - 3), rtol=1e-12)
    drawn = impute.truncated_normal(np.array([5.0, 0.0, -3.0, 4.0]), np.array([1.0, 1.0, 1.0, 0.0]), np.full(4, .5), 0.0)
    assert drawn[0] == pytest.approx(5, abs=1e-5) and drawn[1:].tolist() == [0.0, 0.0, 4.0]


def test_imputation_of_thirty_columns(spark):
    """One matrix per run and visit serves a wide panel; what was seen stays, and gaps follow their regression."""
    rng = np.random.default_rng(4)
    factors, loads = rng.normal(size=(600, 3)), rng.normal(size=(3, 30))
    x = factors @ loads + .1 * rng.normal(size=(600, 30)) + 50
    seen = rng.random((600, 30)) > .03
    seen[:, :20] = True
    cols = [f"c{i:02d}" for i in range(30)]
    rows = [(i, *[float(v) if s else None for v, s in zip(vs, ss)]) for i, (vs, ss) in enumerate(zip(x, seen))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)).withColumn("note", F.lit("n"))
    out = impute.impute_chained(df, ["id"], cols, runs=2, sweeps=2)
    assert out.columns == [*df.columns, "imputation_run"] and out.count() == 1200
    for r in range(2):
        got = out.where(F.col("imputation_run") == r).orderBy("id").toPandas()[cols].to_numpy()
        assert (got[seen] == x[seen]).all() and np.abs(got[~seen] - x[~seen]).std() < .3
    whole = impute.cross_products(df.na.drop(), cols, [50.0] * 30)
    full = np.column_stack([np.ones(seen.all(axis=1).sum()), x[seen.all(axis=1)] - 50])
    assert np.allclose(whole, full.T @ full)
