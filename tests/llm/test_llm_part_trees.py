import hashlib
import math
import random

import numpy as np
import pytest

from areaindex.llm import part_trees
from areaindex.llm.part_trees import anchors, block_codes, block_sums, compress, integers, plant, settle


def brute(rows, parts=8, entries=16, rounds=6):
    """(codes, errors, books) of rows (id, vector) by plain Python integers."""
    kept = [(k, v) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    share = max(1, -(-width // parts))
    whole = [[math.floor(4096 * x) for x in v] + [0] * (share * parts - len(v)) for _, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[whole[i][p * share : (p + 1) * share] for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for turn in range(rounds + 1):
        near = [[nearest(w[p * share : (p + 1) * share], books[p]) for p in range(parts)] for w in whole]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [w[p * share : (p + 1) * share] for w, n in zip(whole, near) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    flat = ",".join(str(v) for b in books for c in b for v in c)
    return (
        sorted((kept[i][0] is None, kept[i][0] or 0, bytes(n[1] for n in near[i]).hex(), sum(n[0] for n in near[i])) for i in range(len(kept))),
        hashlib.sha256(flat.encode()).hexdigest(),
    )


def table(spark, rows, kind="float"):
    return spark.createDataFrame(
        [(k, v, lab, 1, 2) for k, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, `key` int, `code` int"
    )


def check(spark, rows, kind="float"):
    done, books = compress(table(spark, rows, kind).repartition(3))
    got = done.collect()
    codes, digest = brute([(k, v) for k, v, _ in rows])
    assert sorted((r.key is None, r.key or 0, bytes(r.code).hex(), r.error) for r in got) == codes
    assert books.digest() == digest
    totals = {}
    for r in got:
        totals[r.label] = totals.get(r.label, 0) + r.error
    assert all(r.label_error == totals[r.label] for r in got)
    return got


def vectors(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * spread
    return np.float32(centres[rng.integers(0, 5, n)] + rng.normal(size=(n, width)) * 0.05).astype(float).tolist()


def test_codes_against_plain_integers(spark):
    rng = random.Random(2)
    vecs = vectors(400, 24, 1)
    rows = [(i, v, rng.choice([None, 1, 2, 3])) for i, v in enumerate(vecs)]
    rng.shuffle(rows)
    check(spark, rows)


def test_copies_ties_and_left_out_rows(spark):
    vecs = vectors(60, 16, 3)
    rows = [(i, vecs[i % 7], i % 2) for i in range(300)] + [(5, vecs[9], 1), (None, vecs[10], None), (None, vecs[11], None)]
    rows += [(900, None, 1), (901, [*vecs[0][:-1], None], 1), (902, [*vecs[0][:-1], float("nan")], 1), (903, [float("inf"), *vecs[0][1:]], 1)]
    got = check(spark, rows)
    assert len(got) == 303 and {r.key for r in got}.isdisjoint({900, 901, 902, 903})


@pytest.mark.parametrize("case", ["few", "one", "short", "odd", "large", "huge"])
def test_odd_tables(spark, case):
    vecs = vectors(40, 16, 5)
    rows = {
        "few": [(i, v, 1) for i, v in enumerate(vecs[:9])], "one": [(2**60, vecs[0], None)],
        "short": [(i, v[: i % 17], 0) for i, v in enumerate(vecs)], "odd": [(i, v[:13], 0) for i, v in enumerate(vecs)],
        "large": [(i, [x * 3e4 for x in v], 0) for i, v in enumerate(vecs)],
        "huge": [(i, [x * (1e6 if i % 5 == 0 else 1) for x in v], i % 2) for i, v in enumerate(vecs)],
    }[case]
    check(spark, rows, "double")


def test_beyond_a_long_and_empty(spark):
    rows = [(i, [1e300 * (-1) ** i, *[float(i)] * 7], i % 3) for i in range(20)]
    done, books = compress(table(spark, rows, "double"))
    assert done.count() == 20 and len(books.entries[0]) == 16
    codes, digest = brute([(k, v) for k, v, _ in rows])
    assert books.digest() == digest
    assert sorted((False, r.key, bytes(r.code).hex()) for r in done.collect()) == [c[:3] for c in codes]
    assert compress(table(spark, []))[0].count() == 0 and compress(table(spark, [(1, None, 1)]))[0].count() == 0
    assert compress(table(spark, [(1, [], 1)]))[0].first().error == 0


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rows = [(i, v, 1) for i, v in enumerate(vectors(700, 8, 7))]
    want = compress(table(spark, rows).coalesce(1))
    monkeypatch.setattr(part_trees, "BLOCK_VALUES", 8)
    got = compress(table(spark, rows).coalesce(1))
    assert sorted(map(tuple, want[0].collect())) == sorted(map(tuple, got[0].collect())) and want[1].digest() == got[1].digest()


@pytest.mark.parametrize("seed", range(4))
def test_trees(seed):
    rng = np.random.default_rng(seed)
    points = np.floor(rng.normal(size=(600, 4)) * [500, 500, 1, 1] + rng.integers(0, 3, (600, 1)) * 4000)
    if seed == 3:
        points[:400] = points[0]
    tree = plant(points, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(600))
    for at in range(len(tree.start)):
        own = points[tree.order[tree.start[at] : tree.stop[at]]]
        assert (own.sum(axis=0) == tree.sums[at]).all()
        assert np.sqrt(((own - tree.centre[at]) ** 2).sum(axis=1)).max() <= tree.radius[at]
        if tree.left[at] >= 0:
            assert tree.left[at] < at and tree.right[at] < at
    book = points[rng.choice(600, 16)]
    book[7] = book[2]
    plain = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    code, far = block_codes(tree, points, book)
    assert (code == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()
    sums = block_sums(tree, points, book)
    for e in range(16):
        assert sums[e].tolist() == [*points[code == e].sum(axis=0).astype(int).tolist(), int((code == e).sum())]


def test_whole_balls_are_owned():
    rng = np.random.default_rng(0)
    points = np.floor(rng.normal(size=(4000, 8)) * 40 + rng.integers(0, 16, (4000, 1)) * 3000)
    book = np.floor(np.arange(16)[:, None] * 3000 + np.zeros((16, 8)))
    owned, index, _ = settle(plant(points), points, book)
    assert len(index) < 40 and len(owned) < 600


def test_anchors_are_the_nearest_of_theirs():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 3))
    owner = anchors(points, 20)
    assert len(set(owner.tolist())) == 20
    assert anchors(np.ones((9, 2)), 3).tolist() == [0] * 9


def test_integers_floor_down():
    assert integers([[-0.0001, 0.0001, -1.0]], 4).tolist() == [[-1.0, 0.0, -4096.0, 0.0]]
    assert integers([[3e38]], 1)[0, 0] == int(3e38) * 4096
