"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of a benchmark item, or the whole of a shorter
item. Containing a window means containing each of its words, so one necessary
word is enough to find it: its rarest in the corpus. Each window is filed under
that word with its place, corpus words meet these few rare keys, the place tells
where the window would lie, and length and position bounds drop what would not
fit. What remains is confirmed word by word.

Two passes over the texts: corpus counts of the benchmark's words, and the
windows themselves. A text meets the filed words in a broadcast join, and where
one stands, only the few words around it go on to be compared; so no text is
ever shuffled. What is filed is broadcast in blocks of a measured size, one for
any but very large benchmarks.

Defined results: a NULL or empty text has no words, no hits and is clean; items
without words have no window; documents are told apart by id and text, so rows
that repeat are judged alike and all returned; NULL ids are kept; an empty table
of items leaves all documents clean; further input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaindex.llm.common import col, written
from areaindex.session import BROADCAST_BYTES, join_measured

WINDOW = 13
#: Words of a text that are cut out together.
STRETCH = 64
# A-Z become small letters, other ASCII characters but digits and small letters part words.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words of a text as an array; none for NULL."""
    plain = F.translate(text, _CAPITALS + _PARTING, _CAPITALS.lower() + " " * len(_PARTING))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key, text)


def corpus_counts(texts: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """(word, n) for every word of the vocabulary that the texts hold."""
    found = texts.select(F.explode(words(F.col("text"))).alias("word"))
    return join_measured(found, vocabulary, ["word"], 64 * size).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows filed under their rarest word: (word, item_id, place, first, segment).

    One row covers all windows of an item that share a rarest word at ``place``;
    ``segment`` holds the item's words from the first of these windows to the
    end of the last.
    """
    rated = (
        items.select("item_id", "item_words", F.size("item_words").alias("n_item"),
                     F.posexplode("item_words").alias("start", "word"))
        .join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    )
    ahead = Window.partitionBy("item_id", "item_words").orderBy("start").rowsBetween(0, window - 1)
    rarest = rated.withColumn("rarest", F.min(F.struct("n", "word", F.col("start").alias("place"))).over(ahead))
    return (
        rarest.where(F.col("start") <= F.greatest(F.col("n_item") - window, F.lit(0)))
        .groupBy("item_id", "item_words", "rarest.word", "rarest.place")
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
        .withColumn("length", F.least(F.size("item_words"), F.lit(window)))
        .withColumn("segment", F.slice("item_words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("length")))
        .select("word", "item_id", "place", "first", "length", "segment")
    )


def overlap(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): (row, key, n_words) for every row, and (row, item_id, start, stop) of windows found."""
    texts = docs.select(
        col(key).alias("key"), col(text).cast("string").alias("text"),
        row_key(col(key), col(text).cast("string")).alias("row"),
    )
    pieces = written(
        items.select(col(item_key).alias("item_id"), words(col(item_text).cast("string")).alias("item_words"))
        .where(F.size("item_words") > 0).distinct(), "items",
    )
    vocabulary = written(pieces.select(F.explode("item_words").alias("word")).distinct(), "vocabulary")
    counts = written(corpus_counts(texts, vocabulary, vocabulary.count()), "counts")
    filed = written(anchors(pieces, counts, window), "anchors")
    n_filed, width = filed.agg(F.count(F.lit(1)), F.sum(F.size("segment"))).first()

    # the empty word ends every text: it carries the number of words through the same pass
    end = filed.sparkSession.range(1).select(F.lit("").alias("word"), *[
        F.lit(None).cast(filed.schema[c].dataType).alias(c) for c in filed.columns if c != "word"
    ])
    placed = _placed(texts, window - 1)
    n_blocks = max(1, -(-(64 * (n_filed or 0) + 24 * (width or 0)) // BROADCAST_BYTES))
    found = None
    for block in range(n_blocks):
        part = filed.where(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == block) if n_blocks > 1 else filed
        met = placed.join(F.broadcast(part if block else part.unionByName(end)), "word")
        found = met if found is None else found.unionByName(met)
    start = F.col("at") - F.col("place") + F.col("first")
    ahead = start - F.col("held_from")  # where the segment starts among the words held; before them, it starts before the text
    around = found.select(
        "row", F.when(F.col("word") == "", F.col("key")).alias("key"), (F.col("word") == "").alias("is_end"), "at", "item_id",
        start.alias("start"), "length", "segment",
        F.slice("held", F.greatest(ahead, F.lit(0)) + 1, F.greatest(F.size("segment") + F.least(ahead, F.lit(0)), F.lit(0))).alias("around"),
    )
    found = written(around.select(
        "row", "key", "is_end", "at", "item_id", "start", "length", F.when(~F.col("is_end"), _standing()).alias("windows")
    ), "found")
    documents = found.where("is_end").select("row", "key", F.col("at").cast("long").alias("n_words"))
    matches = (
        found.where("NOT is_end").select("row", "item_id", "start", "length", F.explode("windows").alias("i"))
        .select("row", "item_id", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + F.col("length")).alias("stop"))
        .distinct()
    )
    return documents, matches


def _placed(texts: DataFrame, reach: int) -> DataFrame:
    """(row, key, at, word, held, held_from): every word, with the words of its stretch of the text and ``reach`` around it.

    The empty word follows the last one. Texts are cut into stretches first, so
    what a word carries does not grow with its text.
    """
    split = texts.select("row", "key", F.concat(words(F.col("text")), F.array(F.lit(""))).alias("words"))
    cut = split.select("row", "key", F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRETCH).cast("int")),
        lambda i: F.struct(
            (i * STRETCH).alias("base"), F.slice("words", i * STRETCH + 1, STRETCH).alias("own"),
            F.greatest(i * STRETCH - reach, F.lit(0)).alias("held_from"),
            F.slice(
                "words", F.greatest(i * STRETCH - reach, F.lit(0)) + 1,
                F.least(i * STRETCH, F.lit(reach)) + STRETCH + reach,
            ).alias("held"),
        ),
    )).alias("cut")).select("row", "key", "cut.*")
    return cut.select("row", "key", "base", "held", "held_from", F.posexplode("own").alias("in_stretch", "word")).withColumn(
        "at", F.col("base") + F.col("in_stretch")
    )


def _standing() -> Column:
    """Starts, within the segment, of its windows that stand whole in the words around its anchor."""
    start, length = F.col("start"), F.col("length")
    return F.filter(
        F.sequence(F.lit(0), F.size("segment") - length),
        lambda i: (start + i >= 0)
        & (F.slice("around", F.greatest(i + F.least(start, F.lit(0)), F.lit(0)) + 1, length) == F.slice("segment", i + 1, length)),
    )


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: int = 20,
) -> DataFrame:
    """(key, row, n_words, n_hit, n_items, items_sha256, contaminated) for every document.

    Contaminated: at least one word in ``share`` lies inside a window found.
    """
    documents, matches = overlap(docs, items, key, text, item_key, item_text, window)
    matches = written(matches, "matches")
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    hits = (
        matches.select("row", "start", "stop").distinct()
        .withColumn("done", F.coalesce(F.max("stop").over(before), F.lit(0)))
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "done"))).alias("n_hit"))
    )
    named = matches.groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    joined = documents.join(hits, "row", "left").join(named, "row", "left").select(
        F.col("key").alias(key), "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("ids"),
    )
    return joined.select(
        col(key), "row", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
