import random
import re

from pyspark.sql import functions as F

from areaindex.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, items, size=13):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            wins = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items_table(spark, items):
    return spark.createDataFrame([(*r, 0, 0) for r in items], "item_id long, text string, word int, n int")


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(7)
    vocabulary = [f"t{i}" for i in range(12)]

    def text(n):
        return " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 30, 60]))) for i in range(25)] + [(99, ""), (100, None), (101, "T1, t1"), (101, "t2 t2")]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w = words(items[rng.randrange(25)][1])
            a = rng.randrange(len(w))
            parts += [" - ".join(w[a:a + rng.randint(1, 40)]).upper(), text(rng.randint(0, 10))]
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "É t1 T1!"), (None, text(50)), (7, rows[7][1])]
    got = decontam.contamination(make_docs(rows), items_table(spark, items)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got], key=str) == brute(rows, items)


def test_edges(spark, make_docs):
    none = decontam.contamination(make_docs([(1, "a b")]), items_table(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
    assert decontam.contamination(make_docs([]), items_table(spark, [(1, "a b")])).count() == 0
    long = " ".join(["x"] * 60_000) + " a needle here " + "y" * 50_000
    row = decontam.contamination(make_docs([(1, long)]), items_table(spark, [(4, "needle here"), (12, "a needle")])).first()
    digest = spark.range(1).select(F.sha2(F.lit("12,4"), 256)).first()[0]
    assert (row.n_hit, row.n_items, row.items_sha256, row.contaminated) == (3, 2, digest, False)


def test_plan_runs_no_python(spark, make_docs):
    frame = decontam.contamination(make_docs([(1, "a b c")], extra=False), items_table(spark, [(1, "a b")]))
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())
