import random
import re

import pytest

from areaindex.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(hit),
    )


def test_measures_match_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b ", "é", "\n", "\t", "#", " ", "a b a b ", "\x0b", "\x85", " ", "漢"], k=rng.randint(0, 90)))
        assert rules.measure_text(text)[:5] == brute(text), repr(text)


def test_long_repeats_and_overlaps():
    text = " ".join(["x"] * 5000)
    assert rules.measure_text(text)[4] == 5000
    assert rules.repeated_words([b"a"] * 9) == 9 and rules.repeated_words([b"a"] * 8) == 0
    assert rules.measure_text("y" * 200_000)[:2] == (1, 200_000)


def test_ledger_edges(spark, make_docs):
    good = " ".join(f"word{i}" for i in range(40))
    docs = make_docs([(1, None), (2, ""), (3, good), (3, good), (None, good), (4, "A B " * 30)])
    rows = rules.ledger(docs).withColumn("kept", rules.verdict("v2")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in rows) == [
        (False, 1, False), (False, 2, False), (False, 3, True), (False, 3, True), (False, 4, False), (True, 0, True)
    ]
    assert rules.ledger(make_docs([])).count() == 0
    assert {r.failed & 1 for r in rows if r.doc_id in (1, 2)} == {1}


def test_ablations_match_verdicts(spark, make_docs, babble):
    texts = babble(30) + ["# " * 40, "a b", "SHOUT " * 30, None, "x | y | z | " * 10]
    entries = rules.ledger(make_docs(list(enumerate(texts)))).cache()
    kept = entries.where(rules.verdict("v2")).count()
    found = {r.rule: r for r in rules.ablations(entries).collect()}
    assert set(found) == set(rules.POLICIES["v2"])
    for name, row in found.items():
        others = [n for n in rules.POLICIES["v2"] if n != name]
        without = entries.where(f"failed & {rules.mask_of(others)} = 0").count()
        assert (row.n_kept, row.n_kept_without, row.n_only) == (kept, without, without - kept)
        assert row.n_failed == entries.where(f"failed & {rules.mask_of([name])} <> 0").count()
    with pytest.raises(ValueError):
        rules.mask_of(["no such rule"])
    empty = rules.ablations(rules.ledger(make_docs([]))).collect()
    assert all(r.n_kept == 0 for r in empty)
