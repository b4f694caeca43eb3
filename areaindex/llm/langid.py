"""Language of texts and of their words, by a linear-chain CRF.

Words of a text are labelled together, so a passage in another language stands
out while a single borrowed word does not. The text's language is the label with
the largest total probability over its words, its score the label's share.

Defined results: a NULL text or one without letters is ``und`` with score 0; so
is every text when nothing could be learned; ties go to the label first in the
alphabet; equal texts have equal results; an empty table gives no rows; further
input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows, per_process
from areaindex.llm.word_crf import CACHE_WORDS, WordCrf, letters_of

#: Texts of a language to learn from, and the characters read of each: the bounds of the sample.
SAMPLE_TEXTS, SAMPLE_CHARS = 250, 600
UNKNOWN = "und"
_TOKEN = re.compile(r"\S+")


def held_out(key: Column) -> Column:
    """Rows of the test fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(excerpt, language) of a bounded number of training rows per language.

    Rows are taken by a hash of their id, at a rate that follows from the number
    of rows of their language; each excerpt begins at a place drawn the same way.
    """
    rows = docs.where(col(text).isNotNull() & col(lang).isNotNull() & col(key).isNotNull() & ~held_out(col(key)))
    sizes = {r[0]: r[1] for r in rows.groupBy(col(lang)).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, SAMPLE_TEXTS / n))])
    draw = F.pmod(F.xxhash64(col(key)), F.lit(1_000_000)) / 1e6
    offset = F.pmod(F.xxhash64(col(key), F.lit(1)), F.greatest(F.length(col(text)) - SAMPLE_CHARS, F.lit(1))) + 1
    chosen = rows.where(draw < F.element_at(share, col(lang))).select(
        F.substring(col(text), offset.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), col(lang).alias("l"), F.xxhash64(col(key)).alias("h")
    )
    found: list[tuple[str, str]] = []
    taken = dict.fromkeys(sizes, 0)
    for t, name, _ in sorted(map(tuple, chosen.limit(3 * SAMPLE_TEXTS * len(sizes)).collect()), key=lambda r: (r[2], r[0])):
        if taken[name] < 2 * SAMPLE_TEXTS:
            taken[name] += 1
            found.append((t, name))
    return found


def words_of(text: str) -> list[str]:
    return [w for w in map(letters_of, text.lower().split()) if w]


def train(sample: list[tuple[str, str]]) -> WordCrf:
    model = WordCrf(sorted({name for _, name in sample}))
    model.fit([(words_of(t), model.labels.index(name)) for t, name in sample])
    return model


class Labeller:
    """Word potentials kept between texts, and the labelling of groups of texts."""

    def __init__(self, model: WordCrf):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, len(self.model.labels)))
        self.used = 0

    def _learn(self, tokens: list[str]) -> None:
        words = [letters_of(t) for t in tokens]
        real = [i for i, w in enumerate(words) if w]
        for i, w in enumerate(words):
            if not w:
                self.known[tokens[i]] = -1
        if real:
            values = self.model.potentials([words[i] for i in real])
            while self.used + len(real) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.used : self.used + len(real)] = values
            for n, i in enumerate(real):
                self.known[tokens[i]] = self.used + n
            self.used += len(real)

    def posteriors(self, token_lists: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, places of its words among its tokens, label shares per word) of the texts that have words."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        known = self.known
        missing = {t for tokens in token_lists for t in tokens if t not in known}
        if missing:
            self._learn(sorted(missing))
        rows, places, parts = [], [], []
        for i, tokens in enumerate(token_lists):
            ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            real = np.flatnonzero(ids >= 0)
            if len(real):
                rows.append(i)
                places.append(real)
                parts.append(ids[real])
        if rows:
            shares = self.model.posteriors(self.table[np.concatenate(parts)], [len(p) for p in parts])
            yield from zip(rows, places, shares)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, number of places where the language of the words changes) of each text."""
        out = [(UNKNOWN, 0.0, 0)] * len(texts)
        if self.model.labels:
            for i, _, p in self.posteriors([t.lower().split() if t else [] for t in texts]):
                mean, each = p.mean(axis=0), p.argmax(axis=1)
                best = int(mean.argmax())
                score = min(1.0, max(0.0, float(mean[best])))
                out[i] = (self.model.labels[best], score, int((each[1:] != each[:-1]).sum()))
        return out

    def spans(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, float, int]]:
        """(text, start, end, language, score, words) of every stretch of words of one language, in order."""
        if not self.model.labels:
            return
        found = [[(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(t)] if t else [] for t in texts]
        for i, places, p in self.posteriors([[token for _, _, token in tokens] for tokens in found]):
            each, tokens = p.argmax(axis=1), found[i]
            cuts = [0, *(np.flatnonzero(each[1:] != each[:-1]) + 1).tolist(), len(each)]
            for first, after in zip(cuts, cuts[1:]):
                best = int(each[first])
                score = min(1.0, max(0.0, float(p[first:after, best].mean())))
                yield i, tokens[places[first]][0], tokens[places[after - 1]][1], self.model.labels[best], score, after - first


def _grouped(items: Iterator[tuple], text: int) -> Iterator[list[tuple]]:
    """Rows in groups of bounded size, by the length of their texts."""
    held, size = [], 0
    for row in items:
        held.append(row)
        size += len(row[text] or "")
        if size >= 3_000_000 or len(held) >= 2000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _name(model: WordCrf) -> str:
    return "labeller:" + hashlib.sha1(model.weights.tobytes() + model.step.tobytes() + repr(model.labels).encode()).hexdigest()


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: WordCrf | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score, n_switches) for every row; 0 switches in a text without words."""
    model = model or train(training_sample(docs, key, text, lang))
    name, kind = _name(model), docs.select(col(key)).schema[0].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        labeller = per_process(name, lambda: Labeller(model))
        for held in _grouped(items, 2):
            for (k, fold, _), found in zip(held, labeller.label([r[2] for r in held])):
                yield k, fold, *found

    return map_rows(
        docs.select(col(key), held_out(col(key)), col(text).cast("string")),
        f"`{key}` {kind}, held_out boolean, lang_pred string, score double, n_switches long", rows,
    )


def word_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: WordCrf | None = None) -> DataFrame:
    """(key, start, end, lang, score, n_words): the stretches of words of one language in every text.

    Places are code points of the text, the end exclusive. Every word gets its
    most likely label given the whole text; tokens without a letter have none
    and do not end a stretch. A text without words, or NULL, has no rows; of a
    repeated row every copy has its own.
    """
    model = model or train(training_sample(docs, key, text, lang))
    name, kind = _name(model), docs.select(col(key)).schema[0].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        labeller = per_process(name, lambda: Labeller(model))
        for held in _grouped(items, 1):
            for i, *span in labeller.spans([r[1] for r in held]):
                yield held[i][0], *span

    return map_rows(
        docs.select(col(key), col(text).cast("string")),
        f"`{key}` {kind}, `start` long, `end` long, lang string, score double, n_words long", rows,
    )
