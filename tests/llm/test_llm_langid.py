import random
import zlib

import numpy as np

from areaindex.llm import langid
from areaindex.llm.word_crf import SEGMENT, WordCrf

WORDS = {
    "de": "der die und nicht ich ein zu haben werden sein straße häuser wissenschaft bücher zeitung".split(),
    "en": "the and not with have that from this would there house books science newspaper street".split(),
    "es": "el la que los para una como pero más casa calle libros ciencia periódico años".split(),
}


def text(lang, n, rng):
    return " ".join(rng.choices(WORDS[lang], k=n))


def corpus(n=240):
    rng = random.Random(1)
    return [(i, text(lang, rng.randint(5, 80), rng), lang, "s") for i, lang in ((i, rng.choice(list(WORDS))) for i in range(n))]


def test_posteriors_are_exact_for_any_length():
    rng = np.random.default_rng(3)
    model = WordCrf(["a", "b", "c"])
    model.step = rng.normal(size=(3, 3))
    lengths = [1, 5, SEGMENT, SEGMENT + 1, 3 * SEGMENT + 17, 2, 2 * SEGMENT]
    p = np.exp(rng.normal(size=(sum(lengths), 3)) * 3)
    p /= p.max(axis=1, keepdims=True)
    got, a, at = model.posteriors(p, lengths), np.exp(model.step), 0
    for n, g in zip(lengths, got):
        e = p[at:at + n]
        ahead, back = np.empty((n, 3)), np.ones((n, 3))
        ahead[0] = e[0] / e[0].sum()
        for t in range(1, n):
            ahead[t] = (ahead[t - 1] @ a) * e[t]
            ahead[t] /= ahead[t].sum()
        for t in range(n - 2, -1, -1):
            back[t] = a @ (e[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        want = ahead * back / (ahead * back).sum(axis=1, keepdims=True)
        assert np.abs(want - g).max() < 1e-9
        at += n


def test_held_out_accuracy_and_fold(spark, make_docs):
    rows = corpus()
    got = langid.identify(make_docs(rows)).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) >= 0.97


def test_nothing_is_learned_from_the_held_out_fold(spark, make_docs):
    rows = corpus()
    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    a = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(make_docs(rows)).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(make_docs(lied)).collect()}


def test_code_switched_words(spark, make_docs):
    model = langid.train(langid.training_sample(make_docs(corpus())))
    rng = random.Random(9)
    parts = [("de", 30), ("en", 12), ("es", 20)]
    words = [w for lang, n in parts for w in langid.words_of(text(lang, n, rng))]
    labels = [lang for lang, n in parts for _ in range(n)]
    best = model.posteriors(model.potentials(words), [len(words)])[0].argmax(axis=1)
    assert np.mean([model.labels[b] == lang for b, lang in zip(best, labels)]) >= 0.95
    assert all(model.step[i, i] > model.step[i, j] for i in range(3) for j in range(3) if i != j)


def test_stretches_of_languages(spark, make_docs):
    """Stretches follow the text that was put together, cover its words in order, and agree with the number of switches."""
    docs, rng = make_docs(corpus()), random.Random(4)
    model = langid.train(langid.training_sample(docs))
    parts = [(lang, text(lang, n, rng)) for lang, n in (("de", 25), ("en", 25), ("es", 25), ("de", 25))]
    mixed = " 42 -- \n".join(t.upper() for _, t in parts)
    rows = [(1, mixed, None, "s"), (2, None, None, "s"), (3, "", None, "s"), (4, "12 ..", None, "s"), (None, "the house", None, "s"),
            (5, "the books " * 20_000, None, "s"), (6, "the and", None, "s"), (6, "the and", None, "s")]
    got = langid.word_languages(make_docs(rows), model=model).collect()
    held = {k: sorted((r.start, r.end, r.lang, r.n_words) for r in got if r.doc_id == k) for k in (None, 1, 2, 3, 4, 5, 6)}
    assert not (held[2] or held[3] or held[4]) and held[None] == [(0, 9, "en", 2)] and held[6] == [(0, 7, "en", 2)] * 2
    assert held[5] == [(0, len("the books " * 20_000) - 1, "en", 40_000)]
    assert sum(n for *_, n in held[1]) == 100 and all(a[1] <= b[0] and a[2] != b[2] for a, b in zip(held[1], held[1][1:]))
    assert all(mixed[a:b] == mixed[a:b].strip() for a, b, *_ in held[1]) and all(0 < r.score <= 1 for r in got)
    truth, right = [], 0
    for lang, t in parts:
        start = len(" 42 -- \n".join([p for _, p in parts][:len(truth)])) + (9 if truth else 0)
        truth.append((start, start + len(t), lang))
    for start, end, lang in truth:
        right += sum(max(0, min(b, end) - max(a, start)) for a, b, label, _ in held[1] if label == lang)
    assert right >= 0.95 * sum(end - start for start, end, _ in truth)
    switches = {r.doc_id: r.n_switches for r in langid.identify(make_docs(rows), model=model).collect()}
    assert switches[1] == len(held[1]) - 1 and switches[2] == switches[4] == switches[5] == 0
    assert langid.word_languages(make_docs([])).count() == 0


def test_edges(spark, make_docs):
    rows = [*corpus(120), (9001, None, "en", "s"), (9002, "", "en", "s"), (9003, "123 !? 7", None, "s"), (None, "the house and the street", None, None),
            (9004, "the books " * 30_000, "en", None), (9005, "漢字", None, None), (5, "the and", "en", "s"), (5, "the and", "en", "s")]
    got = {r.doc_id: r for r in langid.identify(make_docs(rows)).collect()}
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9001].score == 0
    assert got[None].held_out is False and got[None].lang_pred == "en" and got[9004].lang_pred == "en" and got[9005].lang_pred in WORDS
    assert langid.identify(make_docs([])).count() == 0
    assert [r.lang_pred for r in langid.identify(make_docs([(1, "the house", None, "s")])).collect()] == ["und"]


def test_cache_may_be_emptied(monkeypatch):
    rng = random.Random(2)
    model = langid.train([(text(lang, 60, rng), lang) for lang in WORDS for _ in range(20)])
    texts = [text(lang, 50, rng) for lang in WORDS for _ in range(4)]
    want = langid.Labeller(model).label(texts)
    monkeypatch.setattr(langid, "CACHE_WORDS", 5)
    small = langid.Labeller(model)
    assert [small.label([t])[0][0] for t in texts] == [w[0] for w in want]
