"""Area types: components first, then k-means on them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.functions.clean import row_mean
from areaindex.functions.draws import uniform
from areaindex.operators.weights import pca

#: Points that a task should have at least in each round, and rows that may be open in a run between two passes.
TASK_POINTS = 20_000
OPEN_POINTS = 50_000
_BANDS = 60


def _starts(features: DataFrame, k: int, inits: int, seed: int) -> list[np.ndarray]:
    """k-means++ over all points, one pass a centre for all runs.

    Each centre is drawn by the rows a point stands for times its squared
    distance to the centres before: every point waits for an exponential time of
    that rate, and the first is taken. A run has fewer centres only if there are
    fewer distinct points.
    """
    chosen: list[list[list[float]]] = [[] for _ in range(inits)]
    for step in range(k):
        now = {r: np.array(c) for r, c in enumerate(chosen) if len(c) == step}

        def first(batches: Iterator[pa.RecordBatch], now=now, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, h = batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
                for r, centres in now.items() if len(x) else ():
                    weight = n * np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) if step else n
                    open_ = np.flatnonzero(weight > 0)
                    if len(open_):
                        wait = -np.log(uniform(h[open_], seed, r, step)) / weight[open_]
                        least = wait.min()
                        found = min((float(least), x[i].tolist()) for i in open_[wait == least])
                        best[r] = min(best.get(r, found), found)
            runs = sorted(best)
            yield pa.RecordBatch.from_arrays([
                pa.array(runs, pa.int32()), pa.array([best[r][0] for r in runs], pa.float64()),
                pa.array([best[r][1] for r in runs], pa.list_(pa.float64())),
            ], names=["run", "wait", "point"])

        drawn = features.mapInArrow(first, "run int, wait double, point array<double>").groupBy("run").agg(
            F.min(F.struct("wait", "point")).alias("first")
        ).collect()
        for r, found in drawn:
            chosen[r].append(list(found["point"]))
        if not drawn:
            break
    return [np.array(c) for c in chosen]


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct points of a batch and how many rows each stands for."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy().astype(float)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centre of every point, the squared distance to it, and how much further off the second one is."""
    squares = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    near = squares.argmin(axis=1)
    first = squares[np.arange(len(x)), near]
    if len(centres) == 1:
        return near, first, np.full(len(x), np.inf)
    squares[np.arange(len(x)), near] = np.inf
    return near, first, np.sqrt(squares.min(axis=1)) - np.sqrt(first)


def _band(lead: np.ndarray, scale: float) -> np.ndarray:
    """Band b holds leads from ``scale * 2**((b - BANDS) / 2)`` on; one rule for all passes, so no point falls between two."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(2 * np.log2(lead / scale)) + _BANDS, 0, _BANDS).astype(np.int64)


def _moved(centres: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Centres at the mean of their points; an empty cluster keeps its centre."""
    out = centres.copy()
    held = sizes > 0
    out[held] = sums[held] / sizes[held, None]
    return out


def _passed(features: DataFrame, centres: Mapping[int, np.ndarray], scale: float) -> dict[int, np.ndarray]:
    """One pass over all points: for every run (clusters, bands, coordinates + 2) sums, sizes and costs.

    A point is added up in the band of its lead, by which its second centre is
    further off than its nearest.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: np.zeros((len(c), _BANDS + 1, c.shape[1] + 2)) for r, c in centres.items()}
        for batch in batches:
            x, n = _points(batch)
            for r, c in centres.items() if len(x) else ():
                near, cost, lead = _nearest(x, c)
                np.add.at(sums[r], (near, _band(lead, scale)), np.column_stack([x, np.ones(len(x)), cost]) * n[:, None])
        for r, total in sums.items():
            held = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), r, np.int32)), pa.array(held), pa.array(total.ravel()[held])], names=["run", "place", "value"]
            )

    found = features.mapInArrow(partial, "run int, place long, value double").groupBy("run", "place").agg(F.sum("value").alias("value"))
    out = {r: np.zeros((len(c), _BANDS + 1, c.shape[1] + 2)) for r, c in centres.items()}
    for r, place, value in found.collect():
        out[r].ravel()[place] = value
    return out


@dataclass(frozen=True)
class _Stretch:
    """A run between two passes: its centres in the last pass, those now, and what cannot change in between.

    Points of band ``cut`` and above have a lead of ``safe`` and keep their
    centre while none moves by half of that; ``settled`` are their sums and sizes.
    """

    seen: np.ndarray
    now: np.ndarray
    cut: int
    safe: float
    settled: np.ndarray
    rounds: int


def _advance(stretch: _Stretch, x: np.ndarray, n: np.ndarray, still: float) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Rounds over the open points only: (centres before the last move, centres, rounds, whether they stand still)."""
    now, done = stretch.now, 0
    weighted = np.column_stack([x, np.ones(len(x))]) * n[:, None]
    while done < stretch.rounds:
        if 2 * np.sqrt(((now - stretch.seen) ** 2).sum(axis=1).max()) >= stretch.safe:
            return now, now, done, False
        total = stretch.settled.copy()
        if len(x):
            np.add.at(total, _nearest(x, now)[0], weighted)
        moved, done = _moved(now, total[:, :-1], total[:, -1]), done + 1
        if ((moved - now) ** 2).sum() <= still:
            return now, moved, done, True
        before, now = now, moved
    return now if not done else before, now, done, False


def _advanced(features: DataFrame, stretches: Mapping[int, _Stretch], still: float, scale: float) -> dict[int, tuple]:
    """``_advance`` of every run in a task of its own, over the points that are open in it."""
    def open_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _points(batch)
            for r, s in stretches.items() if len(x) else ():
                mine = np.flatnonzero(_band(_nearest(x, s.seen)[2], scale) < s.cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(mine), r, np.int32)), pa.array(x[mine].tolist(), pa.list_(pa.float64())), pa.array(n[mine])
                ], names=["run", "point", "n"])

    def advance(table: pa.Table) -> pa.Table:
        r = table["run"][0].as_py()
        x = np.array(table["point"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        order = np.lexsort(x.T[::-1])  # sums in one order, however the points arrive
        before, now, rounds, ended = _advance(stretches[r], x[order], table["n"].to_numpy()[order], still)
        return pa.table({
            "run": pa.array([r], pa.int32()), "before": pa.array([before.ravel().tolist()]), "now": pa.array([now.ravel().tolist()]),
            "rounds": pa.array([rounds], pa.int32()), "ended": pa.array([ended]),
        })

    rows = features.mapInArrow(open_points, "run int, point array<double>, n double").groupBy("run").applyInArrow(
        advance, "run int, before array<double>, now array<double>, rounds int, ended boolean"
    ).collect()
    shape = {r: s.now.shape for r, s in stretches.items()}
    return {r: (np.array(b).reshape(shape[r]), np.array(c).reshape(shape[r]), k, e) for r, b, c, k, e in rows}


def _lloyd(features: DataFrame, centres: list[np.ndarray], rounds: int, still: float, scale: float = 1.0) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(cost, sizes, centres) of every run, each moved until its centres move by a squared distance of ``still`` or less.

    ``features`` has distinct points and how many rows each stands for. A pass
    over all points is one exact round of all runs that still move. It also
    tells which points are far from changing their centre; the others, where
    they are few enough for one task, are taken on by themselves for as many
    rounds as the settled ones stay settled, which is exact as well.
    """
    final: dict[int, np.ndarray] = {}
    now, left = dict(enumerate(centres)), dict.fromkeys(range(len(centres)), rounds)
    while now:
        stretches = {}
        for r, total in _passed(features, now, scale).items():
            seen, whole = now[r], total.sum(axis=1)
            moved, left[r] = _moved(seen, whole[:, :-2], whole[:, -2]), left[r] - 1
            if ((moved - seen) ** 2).sum() <= still or not left[r]:
                final[r] = seen
                del now[r]
                continue
            now[r] = moved
            below = np.cumsum(total[:, :, -2].sum(axis=0))  # rows up to each band, at least as many as points
            cut = int(np.searchsorted(below, OPEN_POINTS, side="right"))  # the first band that would be too many
            safe = np.inf if cut > _BANDS else scale * 2.0 ** ((cut - _BANDS) / 2) * (1 - 1e-9) if cut else 0.0
            drift = 2 * np.sqrt(((moved - seen) ** 2).sum(axis=1).max())
            if drift < safe:
                stretches[r] = _Stretch(seen, moved, cut, safe, np.delete(total[:, cut:].sum(axis=1), -1, axis=1), left[r])
        for r, (before, after, done, ended) in (_advanced(features, stretches, still, scale) if stretches else {}).items():
            now[r], left[r] = after, left[r] - done
            if ended or not left[r]:
                final[r] = before
                del now[r]
    results = []
    for r, total in sorted(_passed(features, final, scale).items()):
        whole = total.sum(axis=1)
        results.append((float(whole[:, -1].sum()), whole[:, -2], final[r]))
    return results


def kmeans_labels(
    df: DataFrame, cols: Sequence[str], k: int, inits: int = 10, seed: int = 42, out: str = "cluster",
    rounds: int = 300, tol: float = 1e-4,
) -> DataFrame:
    """Labels of the best of ``inits`` k-means runs, numbered from the largest cluster down.

    Equal rows are one point that weighs as many. Every run draws its starting
    centres from all points, by a hash of their values, so the result does not
    depend on how the rows are laid out; every run moves on all points until its
    centres move less than ``tol`` of the mean variance, or for ``rounds``. The
    run of the lowest cost is taken.
    """
    values = [F.col("__v")[i] for i in range(len(cols))]
    vectors = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("__v"))
    features = vectors.groupBy("__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64("__v")).repartition(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ).persist()
    try:
        count = features.count()
        if not count:
            return df.withColumn(out, F.lit(None).cast("int"))
        # a round is short: a few thousand points are not worth a task
        shared = features.coalesce(max(1, min(features.rdd.getNumPartitions(), count // TASK_POINTS)))
        means = features.agg(*[F.sum(v * F.col("__n")) / F.sum("__n") for v in values]).first()
        spread = features.agg(*[F.sum(F.pow(v - F.lit(float(m)), 2) * F.col("__n")) / F.sum("__n") for v, m in zip(values, means)]).first()
        runs = _lloyd(shared, _starts(shared, k, inits, seed), rounds, tol * float(np.mean(spread)), float(np.sqrt(np.sum(spread))) or 1.0)
        _, sizes, centres = min(runs, key=lambda run: float(f"{run[0]:.9e}"))
    finally:
        features.unpersist()
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i].tolist()))

    def distance(centre: np.ndarray) -> F.Column:
        return reduce(add, [F.pow(F.col(c).cast("double") - F.lit(float(v)), 2) for c, v in zip(cols, centre)])

    nearest = F.array_min(F.array(*[
        F.struct(distance(centres[i]).alias("d"), F.lit(number).alias("n")) for number, i in enumerate(order)
    ]))
    return df.withColumn(out, nearest["n"])


def tandem_clusters(
    df: DataFrame, cols: Sequence[str], k: int, components: int = 5, inits: int = 10, seed: int = 42
) -> DataFrame:
    """Cluster areas on their first principal components; PC1.. stay in the result."""
    found = pca(df, cols)
    scored = found.scores(df, components)
    axes = [f"PC{j + 1}" for j in range(min(components, len(cols)))]
    return kmeans_labels(scored, axes, k, inits, seed)


def cluster_means(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean of each column, size and share in percent, per cluster."""
    sized = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("size"))
    total = sized.agg(F.sum("size")).scalar()
    return sized.withColumn("share_pct", F.col("size") / total * 100)


def cluster_profiles(
    df: DataFrame, pillars: Mapping[str, Sequence[str]], cluster: str = "cluster",
    high: float = 0.66, low: float = 0.33,
) -> DataFrame:
    """Strengths and challenges of each cluster, relative to the other clusters.

    Pillar means are scaled to 0..1 across clusters; a pillar without spread
    counts as 0.5. The frame has one row per cluster.
    """
    cols = list(dict.fromkeys(c for members in pillars.values() for c in members))
    means = cluster_means(df, cols, cluster)
    scored = means.select(
        cluster, "size", "share_pct", *[row_mean(m).alias(f"{p}") for p, m in pillars.items()]
    )
    ranges = scored.agg(F.struct(*[
        F.struct(F.min(F.col(f"`{p}`")).alias("lo"), F.max(F.col(f"`{p}`")).alias("hi")).alias(p) for p in pillars
    ])).scalar()
    scored = scored.withColumn("__r", ranges)

    def relative(p: str):
        lo, hi = F.col(f"__r.`{p}`.lo"), F.col(f"__r.`{p}`.hi")
        return F.coalesce((F.col(f"`{p}`") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.5))

    def listed(test) -> F.Column:
        return F.concat_ws(", ", *[F.when(test(relative(p)), F.lit(p)) for p in pillars])

    strengths, challenges = listed(lambda v: v >= high), listed(lambda v: v <= low)
    text = F.concat_ws(
        "; ",
        F.when(strengths != "", F.concat(F.lit("Strengths: "), strengths)),
        F.when(challenges != "", F.concat(F.lit("Challenges: "), challenges)),
    )
    plain = F.when(text == "", F.lit("Profile: Average/Mixed performance.")).otherwise(text)
    return scored.withColumn("description", plain).drop("__r")


def radar_rows(df: DataFrame, pillars: Mapping[str, Sequence[str]], cluster: str = "cluster") -> DataFrame:
    """Pillar means per cluster as rows: cluster, pillar, value."""
    cols = list(dict.fromkeys(c for members in pillars.values() for c in members))
    means = cluster_means(df, cols, cluster)
    wide = means.select(cluster, *[row_mean(m).alias(p) for p, m in pillars.items()])
    return wide.unpivot([cluster], [f"`{p}`" for p in pillars], "pillar", "value")

