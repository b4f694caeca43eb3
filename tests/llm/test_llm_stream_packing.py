import random

import numpy as np
import pytest

from areaindex.llm import byte_tokens
from areaindex.llm.queries import vocabulary
from areaindex.llm.stream_packing import LevelArray, Piece, pack_stream, split, stream

PATH = vocabulary("byte_bpe_50k.json")


def ids_of(n, first=0):
    return np.arange(first, first + n, dtype="<u4").tobytes()


def test_ids_equal_the_tokenizer_on_odd_texts():
    encoder, rng = byte_tokens.BytePieces(PATH), random.Random(1)
    parts = ["it's", "WE'LL", "''d", "9", "½", " ", "\n", "naïve", "Straße", "漢字", "<|endoftext|>", "!?'s", "\xa0", "\x1f", "é", "é", "İ",
             "a_b", "x" * 80, "µ", "ª²", "\t", "\r\n", "  ", "×", "'", "don't", "$%", "123abc"]
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(byte_tokens, "CACHE_PIECES", 3)
    encoder = byte_tokens.BytePieces(PATH)
    for text in ("one two three four five", "six seven one", "two eight nine ten", "one two", "  ", "\n"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 12


@pytest.mark.parametrize("size,seed", [(10, 1), (16, 2), (37, 3)])
def test_placement_against_squares_counted_out(size, seed):
    rng, levels, counts = random.Random(seed), LevelArray(size), {}
    for _ in range(400):
        n = rng.randint(1, size - 1)
        best = None
        for level in [0, *sorted(counts)]:
            if level + n > size:
                continue
            after = dict(counts)
            if level:
                after[level] -= 1
            if level + n < size:
                after[level + n] = after.get(level + n, 0) + 1
            score = (sum(c * c for c in after.values()), -level)
            if best is None or score < best[0]:
                best = (score, level, {k: c for k, c in after.items() if c})
        assert levels.level_for(n) == best[1]
        levels.place(Piece((0, n), 0, ids_of(n)))
        counts = best[2]
        assert {i: c for i, c in enumerate(levels.counts.tolist()) if c} == counts
        assert levels.n_open == sum(counts.values())


def test_few_windows_stay_open():
    rng = np.random.default_rng(4)
    levels = LevelArray(100)
    for n in rng.integers(1, 51, 20000).tolist():
        levels.place(Piece((0, n), 0, ids_of(n)))
    assert levels.n_open < 100


@pytest.mark.parametrize("open_windows", [1, 7, 4096])
def test_windows_hold_every_token_once_and_need_no_padding(open_windows):
    rng, size = random.Random(open_windows), 64
    documents = [(i, ids_of(rng.choice([1, 2, 37, 38, 64, 65, 200, rng.randint(1, 90)]), 1000 * i)) for i in range(500)]
    windows = list(stream(iter(documents), size, open_windows))
    got = {}
    for window in windows:
        n = sum(p.length for p in window)
        assert n == size or (n < size and n & (n - 1) == 0), n
        for p in window:
            assert p.length > 0 and p.document[1] == len(documents[p.document[0]][1]) // 4
            got.setdefault(p.document[0], {})[p.start] = p.ids
    for key, ids in documents:
        assert b"".join(got[key][s] for s in sorted(got[key])) == ids
        assert [s for s in sorted(got[key])][0] == 0
    if open_windows == 4096:  # a document is cut where a window is full, and once per window closed
        total = sum(len(i) // 4 for _, i in documents)
        assert len(windows) <= total / size + 8 + sum(1 for w in windows if sum(p.length for p in w) < size)
    assert list(stream(iter([]), size)) == []


def test_equal_lengths_above_half_are_bounded():
    windows = list(stream(((i, ids_of(600)) for i in range(1000)), 1024, 50))
    assert sum(sum(p.length for p in w) for w in windows) == 600_000
    assert sum(1 for w in windows if sum(p.length for p in w) == 1024) > 550


def test_split():
    window = [Piece((0, 5), 0, ids_of(5)), Piece((1, 3), 0, ids_of(3))]
    for at in range(9):
        a, b = split(window, at)
        assert sum(p.length for p in a) == at and b"".join(p.ids for p in a + b) == ids_of(5) + ids_of(3)
        assert all(p.length for p in a + b)


def test_round_trip(spark, make_docs, babble):
    texts = babble(80, low=5, high=900) + [None, "", " \n ", "z" * 30_000, "It's 漢字 <|endoftext|>"]
    big = 2**53 + 1
    docs = make_docs([*enumerate(texts), (3, texts[3]), (None, "null id"), (big, "one"), (big + 2, "two")])
    rows = pack_stream(docs.repartition(3), PATH).collect()
    encoder = byte_tokens.BytePieces(PATH).tokenizer
    got, by = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        if r.doc_id != 3:
            got.setdefault(r.doc_id, {})[r.start] = r
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        n = sum(p[1] for p in parts)
        assert [p[0] for p in parts] == np.r_[0, np.cumsum([p[1] for p in parts])[:-1]].tolist()
        assert n == 1024 or n & (n - 1) == 0
    for key, text in [*((i, t) for i, t in enumerate(texts) if i != 3), (None, "null id"), (big, "one"), (big + 2, "two")]:
        want = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        parts = [got[key][s] for s in sorted(got[key])]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want
        assert {p.doc_tokens for p in parts} == {len(want)}
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert pack_stream(make_docs([]), PATH).count() == 0
