import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from areaindex.llm import ball_search
from areaindex.llm.ball_search import BallTree, Best, Query, Rows, bounds, plant, rank, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """(item, rank, doc, score) by plain Python integers."""
    words = [(d, plain_terms(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    held = [(d, len(w), Counter(w)) for d, w in words]
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for d, n, c in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in asked.items() if t in c
            )
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "item_id long, text string, `query` int, `key` int")


def run(docs, items, **options):
    return sorted((tuple(r) for r in rank(docs, items, **options).collect()), key=str)


def corpus(babble, seed=0):
    texts = babble(300, seed=seed, vocabulary=150, low=1, high=80)
    rows = list(enumerate(texts))
    rows += [(1000 + i, texts[5]) for i in range(150)]  # copies: many equal scores
    rows += [(2000, None), (2001, ""), (2002, " \n .,"), (2003, "w1x " * 5000 + "W2X"), (2004, "w3x w3x w3x"), (2005, "ñandú İ 漢字 w4x")]
    random.Random(seed).shuffle(rows)
    return rows


def queries_of(rows, babble):
    return [
        *enumerate(babble(12, seed=99, vocabulary=170, low=1, high=40)), (50, rows[3][1]), (51, rows[3][1]), (52, "Ñandú ñandú 漢字 w4x w4x"),
        (53, None), (54, ""), (55, "unknownword"), (2**60, "w5x"), (56, rows[7][1]),
    ]


@pytest.mark.parametrize("block_terms,seeds,leaf", [(1 << 18, 16, 64), (300, 1, 4), (60, 2, 1)])
def test_ranks_against_all_scores(spark, make_docs, babble, monkeypatch, block_terms, seeds, leaf):
    monkeypatch.setattr(ball_search, "SEED_BLOCKS", seeds)
    index, grow = ball_search.index, ball_search.plant
    monkeypatch.setattr(ball_search, "index", lambda *a: index(*a, block_terms))
    monkeypatch.setattr(ball_search, "plant", lambda keys, rows: grow(keys, rows, leaf))
    rows = corpus(babble)
    items = queries_of(rows, babble)
    assert run(make_docs(rows).repartition(3), items_of(spark, items)) == brute(rows, items)


def test_queries_in_blocks(spark, make_docs, babble, monkeypatch):
    monkeypatch.setattr(ball_search, "QUERY_BYTES", 700)
    rows = corpus(babble, 3)[:200]
    items = queries_of(rows, babble)
    assert run(make_docs(rows), items_of(spark, items), k=3) == brute(rows, items, 3)


def test_odd_tables(spark, make_docs):
    docs = [(1, "a b"), (1, "a c"), (None, "a b"), (2, "a b"), (2**53 + 1, "a b")]
    items = [(7, "b"), (7, "c c"), (None, "b")]
    assert run(make_docs(docs), items_of(spark, items)) == brute(docs, items)
    assert run(make_docs([]), items_of(spark, items)) == [] == run(make_docs(docs), items_of(spark, []))
    assert run(make_docs([(1, None), (2, ".")]), items_of(spark, items)) == []
    assert run(make_docs(docs), items_of(spark, [(1, None), (2, "zzz")])) == []


def test_terms():
    text = "Él-Niño's 3x_É\x00a\x7fb ß"
    assert [t.decode() for t in terms_of(text)] == plain_terms(text) and terms_of(None) == []


def sparse(rng, n, width, held):
    columns = [np.sort(rng.choice(width, rng.integers(1, held), replace=False)) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    return Rows(rng.integers(1, 10**6, starts[-1]), np.concatenate(columns), starts)


@pytest.mark.parametrize("seed", range(3))
def test_balls_bound_their_documents(seed):
    rng = np.random.default_rng(seed)
    rows = sparse(rng, 500, 60, 12)
    if seed == 1:  # many equal documents
        rows = rows.take(np.concatenate([np.zeros(400, int), np.arange(100)]))
    tree = plant(list(range(500)), rows, leaf=8)
    assert sorted(tree.keys) == list(range(500)) and BallTree.load(*tree.dump()).radius.tolist() == tree.radius.tolist()
    dense = np.zeros((500, 60))
    for at in range(500):
        span = slice(tree.documents.starts[at], tree.documents.starts[at + 1])
        dense[at, tree.terms[tree.documents.columns[span]]] = tree.documents.values[span]
    for _ in range(5):
        terms = np.sort(rng.choice(60, 6, replace=False))
        weights = np.zeros(60, np.int64)
        weights[terms] = rng.integers(0, 9000, 6)
        scores, most = dense @ weights, bounds(tree, weights[tree.terms])
        for node in range(len(tree.first)):
            own = slice(tree.first[node], tree.last[node])
            assert scores[own].max() <= most[node] or scores[own].max() == 0
        best = Best(10)
        search(tree, Query(0, 0, terms, weights[terms]), np.zeros(60, np.int64), best)
        want = sorted((-int(s), False, k) for s, k in zip(scores, tree.keys) if s > 0)[:10]
        assert best.rows == want


def test_balls_are_passed_over():
    rng = np.random.default_rng(5)
    groups = [sparse(rng, 1, 400, 30) for _ in range(40)]
    rows = Rows(np.concatenate([np.tile(g.values, 50) for g in groups]), np.concatenate([np.tile(g.columns, 50) for g in groups]),
                np.concatenate([[0], np.cumsum([len(g.values) for g in groups for _ in range(50)])]))
    tree = plant(list(range(2000)), rows)
    scored = search(tree, Query(0, 0, groups[3].columns, groups[3].values), np.zeros(400, np.int64), Best(10))
    assert scored <= 4 and (tree.left < 0).sum() >= 30
