import random
import re

from areaindex.llm import licenses
from areaindex.llm.license_rules import BASE, RULES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text):
    w, found = words(text), []
    for at in range(len(w)):
        context = " ".join(w[at:at + licenses.REACH])
        for i, r in enumerate(RULES):
            m = re.match(f"^({r.pattern})( |$)", context) if r.keyword == w[at] else None
            if m:
                found.append((at, at + len(m.group(1).split(" ")), i, r))
    kept = []
    for a, b, i, r in found:
        over = [x for x in found if x[:3] != (a, b, i) and x[0] <= a and b <= x[1] and x[3].priority <= r.priority
                and ((x[0], x[1]) != (a, b) or (x[3].priority, x[2]) < (r.priority, i))]
        if r.priority == 0 or not over:
            kept.append((a, r))
    base = [a for a, r in kept if r.priority == 0]
    return (
        len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({r.label for _, r in kept if r.priority == 0})),
        ",".join(sorted({r.label for _, r in kept})), max((r.score for _, r in kept), default=0.0),
    )


def sample(pattern):
    """A text that a rule matches: the first of each choice, without what is optional."""
    previous = None
    while previous != pattern:
        previous, pattern = pattern, re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", lambda m: "" if m.group().endswith("?") else m.group(1), pattern)
    return re.sub(r"\[(.)[^\]]*\]", r"\1", pattern).replace(" ?", " ").strip()


def test_every_rule_is_found(spark, make_docs):
    texts = [f"before {sample(r.pattern)}, after" for r in RULES]
    found = licenses.detections(licenses.marks(make_docs(list(enumerate(texts))))).select("rule").distinct().collect()
    missing = set(range(len(RULES))) - {r.rule for r in found}
    # a rule whose first word has several spellings is filed once for each; the sample shows one of them
    assert all(RULES[i].keyword not in words(texts[i]) for i in missing), [RULES[i] for i in missing]


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(3)
    phrases = [sample(r.pattern) for r in RULES] + [p for p, _ in BASE] * 20
    rows = []
    for i in range(150):
        parts = rng.choices(phrases + ["the", "all", "cc", "license", "general", "Version 2.0", "é"], k=rng.randint(0, 12))
        rows.append((i, rng.choice([" ", ", ", "-", "\n"]).join(p.upper() if rng.random() < 0.3 else p for p in parts)))
    rows += [(900, None), (901, ""), (None, "All rights reserved"), (5, rows[5][1])]
    got = licenses.scan(make_docs(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)


def test_containment_and_priority(spark, make_docs):
    row = licenses.scan(make_docs([(1, "Licensed under CC BY-NC 4.0. GNU Lesser General Public License v2.1")])).first()
    assert row.labels == "cc-by,cc-by-nc-4.0,gpl,lgpl-2.1,license-mention" and row.base_labels == "cc-by,gpl" and row.score == 1.0


def test_edges(spark, make_docs):
    assert licenses.scan(make_docs([])).count() == 0
    long = "word " * 50_000 + "general public license"
    row = licenses.scan(make_docs([(1, long)])).first()
    assert (row.n_words, row.first_word, row.last_word, row.n_base) == (50_003, 50_000, 50_000, 1)
    plan = licenses.scan(make_docs([(1, "x")], extra=False))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
