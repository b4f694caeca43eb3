"""Positions, ranks and quantiles against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from areaindex.operators import normalise, ordering, panel


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": rng.choice(["a", "b", "c", None], n, p=[.6, .2, .15, .05]),
        "v": rng.integers(0, 60, n).astype(float), "w": np.round(rng.normal(size=n), 3),
    })
    pdf.loc[pdf.id % 3 == 0, "v"] = 7.0  # one value holds a third of all rows
    pdf.loc[pdf.id % 17 == 0, "v"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if x is None or x != x else x for x in r) for r in frame.itertuples(index=False, name=None)]
    rows = [(int(a), b, c, float(d)) for a, b, c, d in rows]
    return spark.createDataFrame(rows, "id int, g string, v double, w double")


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_rank(df, frame, by):
    got = {r["id"]: r["rank"] for r in ordering.average_rank(df, "v", by).collect()}
    groups = frame.groupby("g", dropna=False).v if by else frame.v
    want = groups.rank(ascending=False)
    for i, w in zip(frame.id, want):
        assert (got[i] is None and np.isnan(w)) or got[i] == w


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions(df, frame, by):
    placed = ordering.with_position(df, [F.col("v").desc_nulls_last(), F.col("id")], by)
    got = {r["id"]: r["position"] for r in placed.collect()}
    ordered = frame.sort_values(["v", "id"], ascending=[False, True], na_position="last")
    want = ordered.groupby("g", dropna=False).cumcount() + 1 if by else pd.Series(range(1, len(ordered) + 1), ordered.index)
    assert got == {frame.id[i]: want[i] for i in ordered.index}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(df, frame, by):
    probs = [0.025, 0.25, 0.5, 0.975]
    rows = ordering.quantiles(df, ["v", "w"], probs, by).collect()
    if not by:
        assert len(rows) == 1
    for r in rows:
        part = frame if not by else frame[frame.g.isna()] if r["g"] is None else frame[frame.g == r["g"]]
        for c in ("v", "w"):
            assert np.allclose(r[c], part[c].quantile(probs).to_numpy(), rtol=0, atol=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert ordering.quantiles(empty, ["v"], [0.5]).first()["v"] is None


def test_deciles_match_quantile_cut(df, frame):
    got = {r["id"]: r["decile"] for r in normalise.deciles(df, "w", ["id"]).collect()}
    ranks = frame.sort_values(["w", "id"]).w.rank(method="first")
    want = pd.qcut(ranks, 10, labels=list(range(10, 0, -1))).astype(int)
    assert got == {frame.id[i]: want[i] for i in want.index}


def test_deciles_need_two_values(spark):
    flat = spark.createDataFrame([(i, 3.0) for i in range(20)], "id int, v double")
    assert {r["decile"] for r in normalise.deciles(flat, "v", ["id"]).collect()} == {None}


@pytest.mark.parametrize("n", [2, 3, 10, 11, 12, 25, 37])
def test_deciles_of_small_pools(spark, n):
    pool = spark.createDataFrame([(i, float(i * i)) for i in range(n)], "id int, v double")
    got = [r["decile"] for r in normalise.deciles(pool, "v", ["id"]).orderBy("id").collect()]
    want = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=list(range(10, 0, -1))).astype(int).tolist()
    assert got == want


def test_winsor_minmax_matches_pandas(df, frame):
    spec = {"up": ("w", False), "down": ("w", True), "v_score": ("v", False)}
    out = {r["id"]: r for r in normalise.winsor_minmax(df, spec).collect()}
    for c, score, invert in (("w", "up", False), ("w", "down", True), ("v", "v_score", False)):
        lo, hi = frame[c].quantile(0.025), frame[c].quantile(0.975)
        clipped = frame[c].clip(lo, hi)
        want = ((hi - clipped) if invert else (clipped - lo)) / (hi - lo) * 100
        for i, w in zip(frame.id, want):
            g = out[i][score]
            assert (g is None and np.isnan(w)) or abs(g - w) <= 0.0051
    assert max(abs(r["up"] + r["down"] - 100) for r in out.values()) <= 0.0101
    assert {min(r["up"] for r in out.values()), max(r["up"] for r in out.values())} == {0.0, 100.0}


def test_winsor_minmax_flat_and_empty_columns(spark):
    rows = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None), (3, None, None)], "id int, a double, b double")
    out = normalise.winsor_minmax(rows, {"x": ("a", False), "y": ("b", True), "z": ("gone", False)}).collect()
    assert {(r["x"], r["y"]) for r in out} == {(50.0, 50.0)}
    assert "z" not in out[0].asDict()


def test_cascade_fill(spark):
    rows = [("a", "m1", "t1", 10.0), ("b", "m1", "t1", None), ("c", "m2", "t1", 0.0), ("d", "m3", "t2", None),
            ("e", "m1", "t1", 15.0), ("f", "m1", "t1", 30.0)]
    base = spark.createDataFrame(rows, "id string, mid string, top string, p double")
    got = {r["id"]: r["p"] for r in panel.cascade_fill(base, "p", ["mid", "top"]).collect()}
    # m1 median 15 fills b; t1 then holds 10, 15, 15, 30 and fills c; all of them fill d.
    assert got == {"a": 10, "b": 15, "c": 15, "d": 15, "e": 15, "f": 30}


def test_cascade_fill_without_any_value(spark):
    base = spark.createDataFrame([("a", "m", None), ("b", "m", 0.0)], "id string, mid string, p double")
    assert {r["p"] for r in panel.cascade_fill(base, "p", ["mid"]).collect()} == {0}


def test_percentile_rank(df, frame):
    got = {r["id"]: r["percentile"] for r in normalise.percentile_rank(df, "v").collect()}
    want = frame.v.rank(pct=True) * 100
    for i, w in zip(frame.id, want):
        assert (got[i] is None and np.isnan(w)) or abs(got[i] - w) < 1e-9


def test_keys_may_have_any_name_and_positions_are_long(spark):
    rows = [(g, n, float(v)) for g in ("a", "b") for n in (1, 2) for v in range(5)]
    df = spark.createDataFrame(rows, "w string, n int, v double")
    placed = ordering.with_position(df, [F.col("v")], ["w", "n"])
    assert dict(placed.dtypes)["position"] == "bigint"
    assert sorted(tuple(r) for r in placed.collect()) == [(w, n, v, int(v) + 1) for w, n, v in sorted(rows)]
    ranked = ordering.average_rank(df, "v", ["n", "w"], ascending=True).collect()
    assert all(r["rank"] == r["v"] + 1 for r in ranked)
    middle = ordering.medians(df, ["v"], ["n"]).collect()
    assert sorted((r["n"], r["v"]) for r in middle) == [(1, 2.0), (2, 2.0)]


def test_ranks_have_one_plan(spark, df):
    ranked = ordering.average_rank(df, "v")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # one partition is for the few totals of slices only
    assert "PythonUDF" not in plan and plan.count("Window") == 2
    assert ordering.average_rank(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("accuracy", [1, 2, 10, 10_000])
def test_quantiles_are_exact_however_coarse_the_sketch(spark, accuracy):
    """Coarse sketches miss their positions, so that groups are looked through again."""
    rng = np.random.default_rng(3)
    parts = {
        "wide": 10.0 ** rng.uniform(-300, 300, 1500), "ties": rng.integers(0, 4, 2000).astype(float), "hot": np.r_[np.full(3000, 5.0), rng.normal(size=100)],
        "one": np.array([7.0]), "two": np.array([2.0, -1.0]), "signed": rng.normal(size=777), "inf": np.array([np.inf, -np.inf, 0.0, 1.0]),
    }
    rows = [(g, float(v)) for g, vs in parts.items() for v in vs]
    rng.shuffle(rows)
    rows = [(g, float(v)) for g, v in rows] + [("none", None), (None, 3.0)]
    probs = [0.0, 0.025, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r["v"] for r in ordering.quantiles(spark.createDataFrame(rows, "g string, v double"), ["v"], probs, ["g"], accuracy=accuracy).collect()}
    assert got.pop("none") is None and got.pop(None) == [3.0] * 6
    for g, vs in parts.items():
        ordered = sorted(vs.tolist())
        for p, value in zip(probs, got[g]):
            place = p * (len(ordered) - 1)
            lo, hi = ordered[int(place)], ordered[int(np.ceil(place))]
            want = lo + (hi - lo) * (place - int(place))
            assert value == want or (np.isnan(want) and np.isnan(value)), (g, p)


def test_quantiles_shuffle_hardly_any_value(spark):
    """What one pass leaves of 200,000 distinct values are a few runs."""
    rows = spark.range(200_000).select(F.lit(0).alias("__name"), F.rand(4).alias("__value"))
    runs = ordering._runs(rows, ["__name"], [0.025, 0.5, 0.975], ordering.ACCURACY)
    assert runs.count() < 3 * 5 * 200_000 / ordering.ACCURACY
    assert runs.agg(F.sum("__n")).first()[0] == 200_000
