"""The corpus pipeline: from raw documents to packed token sequences.

Every stage gets what the one before kept, as a written table, and its decisions
take effect: rejected, duplicate and contaminated documents go, personal data is
masked, and what remains is packed. Each stage judges its own input anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.llm import decontam, minhash, packing, pii, quality
from areaindex.llm.common import col, table, without, written
from areaindex.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = written(judged.where("contaminated").select(F.col("row").alias("__row")).distinct(), "contaminated")
    keyed = docs.withColumn("__row", decontam.row_key(F.col("doc_id"), F.col("text").cast("string")))
    return without(keyed, bad, "__row").select(*[col(c) for c in docs.columns])


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; the number of characters follows the text."""
    masked = written(pii.redact(docs), "masked")
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"))
    return packing.pack(written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


STAGES = [
    ("quality", good_documents),
    ("near duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("personal data", private_documents),
    ("packing", packed_documents),
]

#: The stages rest on trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``, each to the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
