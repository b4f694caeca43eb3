import random

import numpy as np
import pytest

from areaindex.llm import minhash


def brute(rows, shingle, percent):
    sets = {i: minhash.shingle_set(minhash.words_of(t), shingle) for i, t in rows if i is not None}
    ids = sorted(sets)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= percent * len(x | y) and label[b] > label[a]:
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def edited(text, rng, share):
    words = text.split()
    return " ".join(f"e{rng.randint(0, 999)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("shingle", [2, 5])
def test_components_match_brute_force(spark, make_docs, babble, shingle):
    rng, rows = random.Random(2), []
    for n, text in enumerate(babble(25, seed=shingle, low=40, high=90)):
        rows.append((n * 10, text))
        rows += [(n * 10 + k, edited(text, rng, rng.choice([0.01, 0.03, 0.08, 0.15]))) for k in range(1, rng.randint(2, 7))]
    rows += [(9001, "Same Text here now"), (9000, "same text HERE now"), (9002, "one"), (9003, "ONE"), (9004, None), (9005, " \n\t ")]
    rng.shuffle(rows)
    got = minhash.near_duplicates(make_docs(rows), shingle=shingle).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, shingle, 80)
    assert len(got) == len(rows)


def test_hot_group_of_near_copies_is_whole(spark, make_docs, babble):
    base, rng = babble(1, low=120, high=120)[0], random.Random(5)
    rows = [(i, edited(base, rng, rng.choice([0.02, 0.05, 0.07]))) for i in range(150)] + [(1000 + i, base) for i in range(200)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows), shingle=2).collect()}
    assert got == {i: label for i, (_, label, _) in brute(rows, 2, 80).items()}


def test_edges(spark, make_docs):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "a b c"), (7, "A B C"), (8, ""), (9, None)]
    got = minhash.near_duplicates(make_docs(rows), shingle=2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (-1, 2, None, True), (-1, 2, None, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True), (9, 0, 9, True)
    ]
    assert minhash.near_duplicates(make_docs([])).count() == 0
    left = minhash.drop_near_duplicates(make_docs(rows), shingle=2)
    assert left.columns == make_docs(rows).columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, -1, 5, 8, 9]


def test_very_long_text(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(40_000))
    got = minhash.near_duplicates(make_docs([(1, text), (2, text + " end"), (3, "z" * 100_000)]), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {1: (39_999, 1), 2: (40_000, 1), 3: (1, 3)}


def test_minimum_and_maximum_estimate_similarity():
    rng, hasher = np.random.default_rng(1), minhash.MinMaxHasher(2, 400, 4)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    a, b = x[:800], x[200:]
    same = hasher.signature(a) == hasher.signature(b)
    assert abs(same[:400].mean() - 0.6) < 0.08 and abs(same[400:].mean() - 0.6) < 0.08
    for band in hasher.order.reshape(hasher.bands, hasher.rows):
        assert len({v % 400 for v in band.tolist()}) == hasher.rows


def test_shingle_hashes_are_distinct_shingles():
    hasher = minhash.MinMaxHasher(3)
    for words in ([b"a"], [b"a", b"b"], [b"a"] * 10, [b"a", b"b", b"a", b"b", b"a", b"b", b"c"]):
        assert len(hasher.shingle_hashes(words)) == len(minhash.shingle_set(words, 3))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300)]
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_ids_are_one_row_by_a_fixed_rule(spark, make_docs, babble):
    """The row that is sketched is the row that stays, whatever the order of the rows."""
    texts = babble(24, seed=9)
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    hashed = {(r.doc_id, r.text): r.h for r in make_docs(rows).selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    first = {i: min((t for j, t in rows if j == i), key=lambda t: hashed[i, t]) for i in range(12)}
    copies = [(100 + i, t) for i, t in first.items()] + [(200 + i, t) for i, t in rows if first[i] != t]
    for order in (rows + copies, (rows + copies)[::-1]):
        left = minhash.drop_near_duplicates(make_docs(order).coalesce(1), shingle=2).collect()
        assert sorted((r.doc_id, r.text) for r in left) == sorted([*first.items(), *copies[12:]])
        judged = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(order), shingle=2).collect()}
        assert all(judged[100 + i] == i and judged[200 + i] == 200 + i for i in range(12))
