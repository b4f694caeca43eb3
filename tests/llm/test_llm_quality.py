import math

import numpy as np

from areaindex.llm import quality


def site_rows(babble):
    good, rows, labels = babble(260, low=40, high=80), [], []
    for i, t in enumerate(good):
        host = "a" if i % 3 else f"h{i % 7}"
        bad = i % 5 == 0
        rows.append((i, " ".join(f"{w}###" for w in t.split()) if bad else t, "en" if i % 2 else "de", host))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return rows, labels


def brute(rows, labels, judged):
    """The hierarchy recomputed row by row from the classifier's probabilities."""
    p = {r.doc_id: r.p_document for r in judged}
    known = {i: q for i, q, _ in labels}
    good = {i: known.get(i, p[i]) for i in p}
    paths, hosts = {}, {}
    for i, _, lang, host in rows:
        paths.setdefault((host, lang), []).append(good[i])
        hosts.setdefault(host, []).append(good[i])
    m = sum(good.values()) / len(good)

    def strength(groups):
        spread = sum(len(g) * (sum(g) / len(g) - q) ** 2 for g, q in groups)
        chance, room = sum(q * (1 - q) for g, q in groups), sum(len(g) * q * (1 - q) for g, q in groups)
        return max(1.0, min(1e6, 1 / max((spread - chance) / max(room, 1e-12), 1e-7) - 1))
    k = strength([(g, m) for g in hosts.values()])
    p_host = {h: (sum(g) + k * m) / (len(g) + k) for h, g in hosts.items()}
    k2 = strength([(g, p_host[h]) for (h, _), g in paths.items()])
    out = {}
    for i, _, lang, host in rows:
        g = paths[host, lang]
        site = (sum(g) - good[i] + k2 * p_host[host]) / (len(g) - 1 + k2)
        odds = math.log(p[i] / (1 - p[i])) - math.log(m / (1 - m)) + math.log(site / (1 - site))
        out[i] = (p_host[host], site, 1 / (1 + math.exp(-odds)))
    return out


def labels_table(spark, labels):
    return spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, p int")


def test_matches_brute_force(spark, make_docs, babble):
    rows, labels = site_rows(babble)
    judged = quality.judge(make_docs(rows), labels_table(spark, labels)).collect()
    want = brute(rows, labels, judged)
    for r in judged:
        assert np.allclose((r.p_host, r.p_path, r.p_quality), want[r.doc_id], rtol=1e-6, atol=1e-9)
        assert r.kept == (r.p_quality >= 0.5) == (r.doc_id % 5 != 0)


def test_sparse_sites_shrink_to_their_host(spark, make_docs, babble):
    rows, labels = site_rows(babble)
    rows += [(1000, rows[1][1], "en", "fresh"), (1001, rows[0][1], "fr", "a")]
    got = {r.doc_id: r for r in quality.judge(make_docs(rows), labels_table(spark, labels)).collect()}
    assert abs(got[1000].p_path - got[1000].p_host) < 0.1 and got[1000].kept and not got[1001].kept
    assert abs(got[1001].p_path - got[1001].p_host) < 1e-9  # its own evidence is left out of its path


def test_edges(spark, make_docs, babble):
    rows, labels = site_rows(babble)
    odd = [(2000, None, None, None), (2001, "", None, None), (None, rows[1][1], "en", "a"), (3, rows[3][1], rows[3][2], rows[3][3]), (2002, "w " * 80_000, "en", "a")]
    got = quality.judge(make_docs([*rows, *odd]), labels_table(spark, [*labels, (1, 1, 0), (7777, 0, 0), (None, 1, 0), (2001, None, 0), (9, 5, 0)])).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.p_quality <= 1 for r in got)
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert quality.judge(make_docs([]), labels_table(spark, labels)).count() == 0
    unlabelled = quality.judge(make_docs(rows[:5]), labels_table(spark, [])).collect()
    assert all(r.kept and r.p_quality == 0.5 for r in unlabelled)
    left = quality.keep_good(make_docs([*rows, *odd]), labels_table(spark, labels))
    assert left.columns == make_docs(rows).columns and left.where("doc_id IS NULL").count() == 1
    assert {r.doc_id for r in left.where("doc_id < 1000").collect()} == {i for i in range(260) if i % 5}


def test_logistic_fit_recovers_weights():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] + 0.5)))).astype(float)
    model = quality.fit_logistic(x, y, ("a", "b"))
    assert np.allclose(np.array(model.weights) / model.scale, [2, -1], atol=0.1) and abs(model.bias - 0.5) < 0.15


def test_rejections_hold_for_null_and_shared_ids(spark, make_docs, babble):
    rows, labels = site_rows(babble)
    good, bad = rows[2], rows[10]
    odd = [(None, bad[1], "en", "a"), (None, good[1], "en", "a"), (3000, bad[1], "en", "a"), (3000, good[1], "en", "a")]
    left = quality.keep_good(make_docs([*rows, *odd]), labels_table(spark, labels)).where("doc_id IS NULL OR doc_id = 3000").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, good[1]), (3000, good[1])]


def test_many_rows_of_one_labelled_id(spark, make_docs, babble):
    """The sample and its balance are of ids: a copied bad document neither hides the good ones nor stops the fit."""
    good = babble(40, low=40, high=80)
    bad = " ".join(f"{w}###" for w in babble(1, seed=7)[0].split())
    rows = [(i, t, "en", "a") for i, t in enumerate(good)] + [(500, bad, "en", "a")] * 20_000
    labels = labels_table(spark, [*((i, 1, 0) for i in range(40)), (500, 0, 0), (500, 0, 1)])
    got = quality.judge(make_docs(rows, extra=False), labels).select("doc_id", "kept").distinct().collect()
    assert {r.doc_id: r.kept for r in got} == {**{i: True for i in range(40)}, 500: False}
