import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from areaindex.llm import packing, tokens
from areaindex.llm.common import written
from areaindex.llm.packing import Limits, best_fit
from areaindex.llm.queries import vocabulary
from areaindex.session import BATCH_BYTES

PATH = vocabulary("word_bpe_49k.json")


def test_ids_equal_the_tokenizer_on_odd_texts():
    encoder, rng = tokens.WordPieces(PATH), random.Random(1)
    parts = ["it's", "WE'LL", "''d", "9", "½", " ", "\n", "naïve", "Straße", "漢字", "<|endoftext|>", "!?'s", " ", "\x1f", "é", "é", "İ", "a_b", "x" * 50, "µ", "ª²"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    encoder = tokens.WordPieces(PATH)
    for text in ("one two three four five", "six seven one", "two eight nine ten", "one two"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_on_every_plain_character():
    encoder, rng = tokens.WordPieces(PATH), random.Random(2)
    plain = [c for c in map(chr, range(256)) if not tokens._UNUSUAL.search(c)]
    texts = [a + b for a in plain for b in ("", "a", "7", "é", "'s", "!", " ")] + ["".join(rng.choices(plain, k=40)) for _ in range(2000)]
    for text in texts:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


def test_words_in_use_outlast_those_met_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    encoder, learnt = tokens.WordPieces(PATH), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda word: learnt.append(word) or learn(word))
    for i in range(200):
        encoder.encode(f"often also rare{i} {'l' * 100}{i}")
        assert len(encoder.known) + len(encoder.older) <= 40
        assert not any(len(w) > tokens.LONGEST_WORD for w in encoder.known)
    assert learnt.count("often") == learnt.count("also") == 1


def test_workers_get_small_batches_while_a_table_is_written(spark):
    conf, rows = "spark.sql.execution.arrow.maxBytesPerBatch", 4000

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    docs = spark.range(0, rows, 1, 1).withColumn("text", F.repeat(F.lit("word "), 1000))
    before = spark.conf.get(conf)
    held = written(docs.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r.n for r in held) == rows and max(r.bytes for r in held) <= 1.1 * BATCH_BYTES
    assert spark.conf.get(conf) == before and conf not in spark.conf.getAll
    spark.conf.set(conf, "200000")
    try:
        own = written(docs.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
        assert max(r.bytes for r in own) <= 220_000 and spark.conf.get(conf).startswith("200000")
    finally:
        spark.conf.unset(conf)


def test_a_table_of_words_gives_the_ids_of_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 30)
    table, rng = tokens.WordTable(PATH), random.Random(4)
    whole = table.pieces.tokenizer
    parts = ["it's", "WE'LL", "''d", "9", "½", " ", "\n", "\t", "naïve", "Straße", "É,", "漢字", "<|endoftext|>", "!?'s", "\x1f", "x" * 70, "µ", "ª²"]
    for _ in range(60):
        texts = [None, "", " \r "] + ["".join(rng.choices([*parts, " ", f" w{rng.randint(0, 60)}"], k=rng.randint(0, 12))) for _ in range(20)]
        rng.shuffle(texts)
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in table.encode(texts)] == want
        assert len(table.words) == len(table.ids) == len(table.met) <= 30
    assert table.encode([]) == [] and table.encode([None, ""]) == [b"", b""]


def test_a_table_learns_each_piece_once_a_call_and_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 40)
    table, learnt = tokens.WordTable(PATH), []
    ids = table.pieces.ids
    monkeypatch.setattr(table.pieces, "ids", lambda piece: learnt.append(piece) or ids(piece))
    table.encode(["pear pear, pear. (pear)", "PEAR pear,", "pear!"])
    assert sorted(learnt) == sorted(["pear", ",", ".", "(", ")", "!"])
    for i in range(200):
        table.encode([f"often also rarely{'abcdefghij'[i % 10] * (i // 10 + 1)}", "often " + "l" * 100])
        assert not any(len(w) > tokens.LONGEST_WORD for w in table.words.to_pylist())
    assert learnt.count("often") == learnt.count("also") == 1


def test_texts_are_encoded_together(monkeypatch):
    monkeypatch.setattr(packing, "TEXT_CHARS", 10)
    monkeypatch.setattr(packing, "TEXT_ROWS", 3)
    rows = [(1, "abcde"), (2, None), (3, "fghij"), (4, ""), (5, None), (6, "x"), (7, "y" * 50), (8, "z")]
    runs = list(packing._batches(iter(rows)))
    assert [[k for k, _ in run] for run in runs] == [[1, 2, 3], [4, 5, 6], [7], [8]] and sum(runs, []) == rows
    assert list(packing._batches(iter([]))) == []


def test_workers_encode_by_the_table_of_words(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "map_rows", lambda df, schema, rows, per_batch: seen.append(rows))
    packing.token_pieces(make_docs([]), PATH)
    calls, encode = [], tokens.WordTable.encode
    monkeypatch.setattr(tokens.WordTable, "encode", lambda table, texts: calls.append(len(texts)) or encode(table, texts))
    got = list(seen[0](iter([(1, "one two"), (None, None), (2, "two")])))
    assert calls == [3] and [(k, n) for k, _, _, n, _ in got] == [(1, 3), (None, 1), (2, 2)]


@pytest.mark.parametrize("choice", ["norm", "dot"])
def test_every_capacity_holds(choice):
    rng = np.random.default_rng(3)
    limits = Limits(100, 4, 3000, choice=choice)
    lengths = rng.integers(1, 50, 500)
    sequence, offset = best_fit(lengths, limits)
    for s in np.unique(sequence):
        at = np.flatnonzero(sequence == s)
        assert lengths[at].sum() <= 100 and len(at) <= 4 and (lengths[at] ** 2).sum() <= 3000
        order = at[np.argsort(offset[at])]
        assert offset[order].tolist() == np.r_[0, np.cumsum(lengths[order])[:-1]].tolist()
    assert sorted(set(sequence.tolist())) == list(range(sequence.max() + 1))
    with pytest.raises(ValueError):
        best_fit([101], limits)
    assert len(best_fit([], limits)[0]) == 0


def test_tight_packing():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 2049, 3000)
    assert best_fit(lengths)[0].max() + 1 <= 1.02 * lengths.sum() / 2048 + 1


def test_pieces_round_trip(spark, make_docs, babble):
    texts = babble(60, low=5, high=400) + [None, "", " \n ", "z" * 30_000, "It's 漢字 <|endoftext|>"]
    docs = make_docs([*enumerate(texts), (3, texts[3]), (None, "null id")])
    ids = packing.token_pieces(docs, PATH).cache()
    limits = Limits()
    placed = packing.pack(ids.drop("ids"), limits, group_size=16).cache()
    assert placed.count() == ids.count()
    encoder = tokens.WordPieces(PATH)
    got = {}
    for r in ids.where("doc_id IS NOT NULL").orderBy("piece").collect():
        got.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
    for i, t in enumerate(texts):
        want = np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(got[i][s] for s in sorted(got[i])) == want
        assert all(len(p) == 4 * 2048 for s, p in got[i].items() if s != max(got[i]))
    rows = placed.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == np.r_[0, np.cumsum([p[1] for p in parts])[:-1]].tolist() and sum(p[1] for p in parts) <= 2048
    whole = packing.sequences(placed.where("doc_id <> 3"), ids.where("doc_id <> 3")).collect()
    sizes = dict(placed.where("doc_id <> 3").groupBy("sequence_id").agg(F.sum("length")).collect())
    assert all(len(r.ids) == 4 * sizes[r.sequence_id] for r in whole)
    assert packing.pack(packing.token_pieces(make_docs([]), PATH).drop("ids")).count() == 0


def test_crc_is_of_little_endian_ids(spark, make_docs):
    row = packing.token_pieces(make_docs([(1, "hello")]), PATH).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids)) and bytes(row.ids).endswith(b"\0\0\0\0")


def test_large_ids_beside_a_null_stay_exact(spark, make_docs):
    big = 2**53 + 1
    ids = [None, big, big + 2, None, 2**62 + 1]
    docs = make_docs([(i, f"text {n}") for n, i in enumerate(ids)])
    placed = packing.pack(packing.token_pieces(docs, PATH).drop("ids")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in placed) == sorted((i is None, i or 0) for i in ids)
    assert dict(packing.pack(packing.token_pieces(docs, PATH).drop("ids")).dtypes)["doc_id"] == "bigint"
