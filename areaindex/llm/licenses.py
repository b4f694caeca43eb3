"""License scan with ordered signature rules, in DataFrame operations only.

One pass over the texts keeps the few places where a rule's keyword stands, each
with the words that follow; only there are the rules of that keyword tried. The
detections of a document are then set against each other: one that lies within a
detection of the same or a stronger priority is suppressed, so "CC BY-NC 4.0"
is not also reported as "CC BY". Detections of the base phrases always stay.

Defined results: a NULL or empty text has no words and no detections; documents
are told apart by id and text, so rows that repeat are judged alike and all
returned; equally strong rules on the same words yield to the earlier one; an
empty table gives no rows; further input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaindex.llm.common import col, written
from areaindex.llm.decontam import row_key, words
from areaindex.llm.license_rules import COMMON, KEYWORDS, PAIRS, RULES

#: Words after a keyword that a rule may look at.
REACH = 16


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of a fixed size."""
    values = ", ".join(
        f"({i}, r'{r.keyword}', r'^({r.pattern})( |$)', '{r.label}', {r.priority}, double({r.score}))"
        for i, r in enumerate(RULES)
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(rule, keyword, pattern, label, priority, score)")


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, at, context): places of keywords, and one row with a NULL context and the word count per document."""
    split = docs.select(
        col(key).alias("key"), row_key(col(key), col(text).cast("string")).alias("row"),
        words(col(text).cast("string")).alias("words"),
    )

    def marked(word: Column, at: Column) -> Column:
        pair = F.concat_ws(" ", word, F.get("words", at + 1))
        return F.when(word.isin(*KEYWORDS), at).when(word.isin(*COMMON), F.when(pair.isin(*PAIRS), at))

    places = F.filter(F.transform("words", marked), lambda at: at.isNotNull())
    contexts = F.transform(places, lambda at: F.struct(
        at.alias("at"), F.array_join(F.slice("words", at + 1, REACH), " ").alias("context")
    ))
    end = F.struct(F.size("words").alias("at"), F.lit(None).cast("string").alias("context"))
    return split.select("row", "key", F.inline(F.concat(contexts, F.array(end))))


def detections(places: DataFrame) -> DataFrame:
    """(row, start, stop, rule, label, priority, score, kept) of every rule that matches at a marked place."""
    found = (
        places.where("context IS NOT NULL").select("row", "at", "context", F.substring_index("context", " ", 1).alias("keyword"))
        .distinct().join(F.broadcast(rule_table(places.sparkSession)), "keyword")
        .withColumn("match", F.expr("regexp_extract(context, pattern, 1)")).where("match <> ''")
        .select(
            "row", F.col("at").cast("long").alias("start"), (F.col("at") + F.size(F.split("match", " "))).cast("long").alias("stop"),
            "rule", "label", "priority", "score",
        )
    )
    before = (
        Window.partitionBy("row").orderBy("start", F.col("stop").desc(), "priority", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def reach(priority: int) -> Column:
        return F.max(F.when(F.col("priority") <= priority, F.col("stop"))).over(before)

    farthest = (
        F.when(F.col("priority") == 0, F.lit(None).cast("long")).when(F.col("priority") == 1, reach(1))
        .when(F.col("priority") == 2, reach(2)).otherwise(reach(3))
    )
    return found.withColumn("farthest", farthest).select(
        "row", "start", "stop", "rule", "label", "priority", "score",
        F.coalesce(F.col("stop") > F.col("farthest"), F.lit(True)).alias("kept"),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every document.

    ``score`` is that of the strongest detection that stands, 0 without any.
    """
    places = written(marks(docs, key, text), "marks")
    base = F.col("priority") == 0

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    judged = detections(places).where("kept").groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"), F.max("score").alias("score"),
    )
    documents = places.where("context IS NULL").select("row", "key", F.col("at").cast("long").alias("n_words"))
    return documents.join(judged, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
