import random

import pytest

from areaindex.llm.queries import vocabulary
from areaindex.llm.token_rollup import DELETE, INSERT, REVISE, TokenRollup, count_tokens

SCHEMA = "action string, doc long, source string, lang string, version string, n_tokens long, seq int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_random_batches_match_a_replay(spark, tmp_path):
    rng, rollup, state = random.Random(3), TokenRollup(spark, str(tmp_path / "r")), {}
    for batch in range(5):
        rows = []
        for doc in rng.sample([None, *range(40)], 25):
            for version in ("v1", "v2"):
                action = rng.choice([INSERT, REVISE, DELETE])
                rows.append((action, doc, rng.choice(["a", "b", None]), rng.choice(["en", None]), version, rng.choice([None, 0, 5, 9])))
                if action == DELETE:
                    state.pop((doc, version), None)
                else:
                    state[doc, version] = (rows[-1][2], rows[-1][3], rows[-1][5] or 0)
        assert rollup.apply(f"b{batch}", frame(spark, rows)) is True
        assert rollup.apply(f"b{batch}", frame(spark, rows[:3])) is False  # committed once
        want = {}
        for (_, version), (source, lang, n) in state.items():
            docs, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (docs + 1, tokens + n)
        assert totals(rollup) == want


def test_unfinished_batch_is_done_again(spark, tmp_path):
    folder = str(tmp_path / "r")
    rollup = TokenRollup(spark, folder)
    rollup.apply("one", frame(spark, [(INSERT, 1, "a", "en", "v", 5)]))
    frame(spark, [(INSERT, 9, "zz", "en", "v", 999)]).write.parquet(f"{folder}/deltas/two")  # left by a lost attempt
    assert totals(rollup) == {("a", "en", "v"): (1, 5)}
    assert rollup.apply("two", frame(spark, [(REVISE, 1, "b", "en", "v", 7)]))
    assert totals(TokenRollup(spark, folder)) == {("b", "en", "v"): (1, 7)} and [m.split("-", 1)[1] for m in rollup.committed()] == ["one", "two"]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """A writer whose number is taken meanwhile sets its changes against the state that the other left."""
    folder = str(tmp_path / "r")
    slow, fast = TokenRollup(spark, folder), TokenRollup(spark, folder)
    plain, meddled = TokenRollup._attempt, []

    def late(self, attempt, seq, changes):
        plain(self, attempt, seq, changes)
        if self is slow and len(meddled) < 2:
            meddled.append(seq)
            fast.apply(f"fast{seq}", frame(spark, [(INSERT, 1, "a", "en", "v", 6 + seq)]))

    monkeypatch.setattr(TokenRollup, "_attempt", late)
    assert slow.apply("slow", frame(spark, [(INSERT, 1, "b", "en", "v", 3)])) is True
    assert meddled == [0, 1]
    assert totals(fast) == {("b", "en", "v"): (1, 3)}  # one document, as the last commit has it
    assert fast.committed() == ["000000000-fast0", "000000001-fast1", "000000002-slow"] and slow.committed() == fast.committed()


def test_same_batch_by_two_writers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "r")
    one, other = TokenRollup(spark, folder), TokenRollup(spark, folder)
    rows = frame(spark, [(INSERT, 1, "a", "en", "v", 5)])
    plain = TokenRollup._attempt

    def late(self, attempt, seq, changes):
        plain(self, attempt, seq, changes)
        if self is one:
            assert other.apply("same", rows) is True

    monkeypatch.setattr(TokenRollup, "_attempt", late)
    assert one.apply("same", rows) is False
    assert totals(one) == {("a", "en", "v"): (1, 5)} and len(one.committed()) == 1


def test_snapshots_bound_what_is_read(spark, tmp_path):
    """With snapshots every second batch the totals and the state are those without, from fewer folders."""
    rng = random.Random(9)
    plain, compact = TokenRollup(spark, str(tmp_path / "p")), TokenRollup(spark, str(tmp_path / "c"), compact_every=2)
    for batch in range(5):
        rows = [(rng.choice([INSERT, REVISE, DELETE]), rng.choice([None, *range(12)]), rng.choice(["a", None]), "en", "v", rng.choice([None, 3, 8])) for _ in range(8)]
        for rollup in (plain, compact):
            assert rollup.apply(f"b{batch}", frame(spark, rows))
        assert totals(plain) == totals(compact)
        live = [sorted(map(repr, map(tuple, r.current().where("live").collect()))) for r in (plain, compact)]
        assert live[0] == live[1]
    assert len(compact._read("state", compact.state_schema).inputFiles()) < len(plain._read("state", plain.state_schema).inputFiles())
    assert compact.compact(4) is False and totals(plain) == totals(compact)


def test_edges(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    assert rollup.apply("empty", frame(spark, [])) and totals(rollup) == {}
    rows = [(INSERT, 1, "a", "en", "v", 5), (INSERT, 1, "a", "en", "v", 5), (INSERT, 1, "a", "en", "v", 8), (INSERT, 2, "a", "en", "v", 1), (DELETE, 2, None, None, "v", None)]
    rollup.apply("ties", frame(spark, rows))
    assert totals(rollup) == {("a", "en", "v"): (1, 8)}
    rollup.apply("gone", frame(spark, [(DELETE, 1, None, None, "v", None), (DELETE, 77, None, None, "v", None)]))
    assert totals(rollup) == {}
    with pytest.raises(ValueError):
        rollup.apply("a/b", frame(spark, rows))


def test_counts(spark, make_docs):
    rows = [(1, "It's one two"), (2, None), (3, ""), (None, "a b"), (1, "It's one two"), (4, "w " * 50_000)]
    got = count_tokens(make_docs(rows), {"words": None, "bpe": vocabulary("word_bpe_49k.json")}).collect()
    assert sorted((r.doc or 0, r.n_tokens) for r in got if r.version == "words") == [(0, 2), (1, 3), (1, 3), (2, 0), (3, 0), (4, 50_000)]
    assert sorted((r.doc or 0, r.n_tokens) for r in got if r.version == "bpe")[:3] == [(0, 2), (1, 4), (1, 4)]
    assert count_tokens(make_docs([]), {"words": None}).count() == 0


def test_query_matches_brute_force(spark):
    from areaindex.llm import queries, tokens

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first = {}
    for r in rows:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    encoder, want = tokens.WordPieces(vocabulary("word_bpe_49k.json")), {}
    for r in rows:
        if first[r.text] == r.doc_id:
            for version, n in (("words-1", len(r.text.encode().split())), ("word_bpe_49k-1", len(encoder.encode(r.text)) // 4 + 1)):
                docs, total = want.get((r.source, r.lang, version), (0, 0))
                want[r.source, r.lang, version] = (docs + 1, total + n)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op3_token_rollup(spark, sf).collect()} == want
