"""Quality of documents by hierarchical empirical Bayes.

A classifier on a text's measurements gives each document's own evidence. Sites
have two levels, host and path. Grouped sums of labels, where there are any, and
of classifier probabilities elsewhere give each site's rate; the spread of rates
between sites, beyond what chance explains, tells how strongly a level is drawn
to the one above: hosts to the whole corpus, paths to their host. A document's
quality is its evidence on top of its path's posterior, from which its own
contribution is taken out.

Defined results: a NULL or empty text is measured as zeros; NULL hosts or paths
form a site of their own; labels other than 0 and 1 and labels of unknown ids
are passed over, of several labels of one id the smallest holds; without labels
of both kinds every document has the prior 0.5 and is kept; rows that repeat are
judged alike and all returned; rows without an id, or that share one but not
the text or site, are judged and dropped each by itself; an empty table gives no
rows; further input columns are kept by ``keep_good`` and not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.llm import rules
from areaindex.llm.common import col, map_rows, without, written
from areaindex.llm.decontam import row_key
from areaindex.session import BROADCAST_BYTES

#: Labelled rows that the classifier is fitted on, at most about this many of each label.
SAMPLE_ROWS = 8000
THRESHOLD = 0.5
_STRENGTH = (1.0, 1e6)


def evidence() -> dict[str, Column]:
    """The classifier's inputs, from a text's measurements; all without a unit."""
    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "size": F.log1p(F.col("n_words")), "short": (F.col("n_words") < 20).cast("double"),
        "word_length": F.least(share("word_chars", "n_words"), F.lit(30.0)),
        "symbols": F.least(share("n_symbols", "n_words"), F.lit(3.0)),
        "any_symbol": (F.col("n_symbols") > 0).cast("double"),
        "repeated_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"),
        "alphabetic": share("n_alpha_words", "n_words"), "capitals": share("n_capitals", "n_letters"),
        "stutter": share("n_stutter", "n_words"),
        "bullets": share("n_bullet_lines", "n_lines"),
    }


@dataclass(frozen=True)
class Classifier:
    names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def log_odds(self) -> Column:
        inputs, total = evidence(), F.lit(self.bias)
        for name, mean, scale, weight in zip(self.names, self.mean, self.scale, self.weights):
            total = total + (inputs[name] - F.lit(mean)) / F.lit(scale) * F.lit(weight)
        return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], ridge: float = 1.0, rounds: int = 30) -> Classifier:
    """Penalised logistic regression by Newton's method; sums in a fixed order, so that repeats agree."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), grad)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(names, tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w[:-1])), float(w[-1]))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(q / (1 - q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _site(host: str, path: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("")) for c in (host, path)]


def _row(key: str, text: str, host: str, path: str) -> Column:
    """Tells rows apart by all that a judgement rests on; NULLs are values."""
    return F.xxhash64(row_key(col(key), col(text).cast("string")), col(key).isNull(), *_site(host, path))


def measured(docs: DataFrame, key: str, text: str, host: str, path: str) -> DataFrame:
    """(row, key, host, path, MEASURES..., n_stutter) with sites as text; NULL is a site of its own."""
    kind = docs.select(col(key)).schema[0].dataType.simpleString()

    def rows(items):
        for r, k, h, p, t in items:
            words = t.lower().split() if t else []
            yield (r, k, h, p, *rules.measure_text(t), sum(map(eq, words, words[1:])))

    chosen = docs.select(_row(key, text, host, path), col(key), *_site(host, path), col(text).cast("string"))
    schema = f"`row` long, `key` {kind}, host string, path string, " + ", ".join(f"{m} long" for m in (*rules.MEASURES, "n_stutter"))
    return map_rows(chosen, schema, rows)


def strength(sites: DataFrame, prior: Column) -> Column:
    """How many documents the level above weighs as, from sites (n, good, weight of prior) by moments.

    The rates' spread around their priors, less what drawing n documents from
    one rate makes, is the spread between sites.
    """
    rate = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * F.pow(rate - prior, 2))
    chance = F.sum(prior * (1 - prior))
    room = F.sum(F.col("n") * prior * (1 - prior))
    between = (spread - chance) / F.greatest(room, F.lit(1e-12))  # variance between sites in units of p(1 - p)
    return F.greatest(F.lit(_STRENGTH[0]), F.least(F.lit(_STRENGTH[1]), 1 / F.greatest(between, F.lit(1e-7)) - 1))


def join_sites(rows: DataFrame, sites: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Sites are broadcast while their measured size allows; beyond, a hot site is split by the skew join."""
    small = 200 * sites.count() <= BROADCAST_BYTES
    return rows.join(F.broadcast(sites) if small else sites, on, how)


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    label: str = "quality", threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, p_document, p_host, p_path, p_quality, kept) for every document."""
    return _judged(docs, labels, key, text, host, path, label, threshold).drop("__row")


def _judged(
    docs: DataFrame, labels: DataFrame, key: str, text: str, host: str, path: str, label: str, threshold: float
) -> DataFrame:
    """``judge`` with the row's own key as ``__row``."""
    table = written(measured(docs, key, text, host, path), "measured")
    known = labels.where(col(label).isin(0, 1)).groupBy(col(key).alias("key")).agg(F.min(col(label)).cast("double").alias("label"))
    known = written(known, "labels")
    labelled = written(table.join(known, "key", "left"), "labelled")
    # ids, not rows: an id that repeats is one draw of the sample
    named = written(labelled.where("label IS NOT NULL").groupBy("key").agg(
        F.max("label").alias("label"), F.min_by(F.struct(*[c.alias(n) for n, c in evidence().items()]), "row").alias("inputs")
    ), "named")
    counts = {r[0]: r[1] for r in named.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(counts) < 2:
        return table.select(
            F.col("row").alias("__row"), F.col("key").alias(key), *[F.lit(0.5).alias(c) for c in ("p_document", "p_host", "p_path", "p_quality")], F.lit(True).alias("kept")
        )

    # the sample: ids of each label whose hash falls below a share that follows from their number
    rate = F.when(F.col("label") == 1, min(1.0, SAMPLE_ROWS / counts[1.0])).otherwise(min(1.0, SAMPLE_ROWS / counts[0.0]))
    inputs = evidence()
    sample = named.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1_000_000)) / 1e6 < rate).select(
        F.xxhash64("key").alias("h"), "inputs.*", "label"
    ).limit(4 * SAMPLE_ROWS).toPandas().sort_values(["h"])
    if sample["label"].nunique() < 2:
        raise ValueError("the sample of labelled rows holds one label only")
    y = sample["label"].to_numpy()
    model = fit_logistic(sample[list(inputs)].to_numpy(float), y, tuple(inputs))
    # the sample's balance is not that of all labelled ids: the bias is moved to the true one
    true, drawn = counts[1.0] / counts[0.0], y.sum() / (len(y) - y.sum())
    shift = float(np.log(true / drawn))
    scored = labelled.withColumn("odds", model.log_odds() + F.lit(shift)).withColumn("p", _sigmoid(F.col("odds"))).withColumn(
        "good", F.coalesce("label", "p")
    ).select("row", "key", "host", "path", "odds", "p", "good")

    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg((F.sum("good") / F.sum("n")).alias("m")).first()["m"]
    if total is None:  # no documents
        total = 0.5
    m = min(max(total, 1e-6), 1 - 1e-6)
    k_host = hosts.agg(strength(hosts, F.lit(m)).alias("k")).first()["k"] or _STRENGTH[0]
    hosts = hosts.select("host", ((F.col("good") + k_host * m) / (F.col("n") + k_host)).alias("p_host"))
    paths = written(join_sites(paths, hosts, ["host"]), "sites")
    k_path = paths.agg(strength(paths, F.col("p_host")).alias("k")).first()["k"] or _STRENGTH[0]

    own = (F.col("site_good") - F.col("good") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)
    sites = paths.select("host", "path", "n", F.col("good").alias("site_good"), "p_host")
    return (
        join_sites(scored, sites, ["host", "path"])
        .withColumn("p_path", F.greatest(F.least(own, F.lit(1 - 1e-9)), F.lit(1e-9)))
        .withColumn("p_quality", _sigmoid(F.col("odds") - _logit(F.lit(m)) + _logit(F.col("p_path"))))
        .select(F.col("row").alias("__row"), F.col("key").alias(key), F.col("p").alias("p_document"), "p_host", "p_path", "p_quality",
                (F.col("p_quality") >= threshold).alias("kept"))
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    label: str = "quality", threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    judged = _judged(docs, labels, key, text, host, path, label, threshold)
    rejected = written(judged.where("NOT kept").select("__row").distinct(), "rejected")
    keyed = docs.withColumn("__row", _row(key, text, host, path))
    return without(keyed, rejected, "__row").select(*[col(c) for c in docs.columns])
