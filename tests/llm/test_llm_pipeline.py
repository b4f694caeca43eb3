"""Each stage against what it is to do with its own input, on the smallest tables."""

import corpus_pipeline as pipeline
import pytest

from areaindex.llm import decontam, minhash, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append((before, docs))
    return kept


def test_stages_and_columns(stages):
    assert len(pipeline.STAGES) == 5
    columns = stages[0][0].columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(i in kept for i in good) / len(good) > 0.97 and sum(i in kept for i in bad) / len(bad) < 0.25


def test_near_duplicates(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = {i: minhash.shingle_set(minhash.words_of(t), 5) for i, t in rows}
    left = {r.doc_id for r in after.collect()}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert left == {i for i in sets if label[i] == i}


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.contamination(before, items).where("contaminated").collect()}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_personal_data(stages):
    before, after = stages[3]
    texts = {r.doc_id: r for r in after.collect()}
    assert len(texts) == before.count()
    for r in before.collect():
        new = texts[r.doc_id]
        assert pii.base_spans(new.text) == [] and new.n_chars == len(new.text)
        if not pii._ANCHOR.search(r.text):
            assert new.text == r.text


def test_packing_and_run(spark, stages):
    before, after = stages[4]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 for parts in used.values())
    whole = pipeline.run(spark, SF)
    assert whole.count() == len(rows) and whole.columns == after.columns
