"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it
returns is written to the shared folder and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stromalens.functions.lineage import materialize
from stromalens.llm import language, near_copies, quality, queries, simhash, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality.keep_good(docs, queries.trusted_documents(spark, sf_dir)).select(COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    return language.annotate(docs, queries.language_model(docs)).where(~F.col("rejected")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash (fingerprints within 3 bits) or by a Jaccard similarity of 0.8 of five-word shingles."""
    return near_copies.one_of_each(docs, groups=simhash.roots(docs)).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that also stand earlier; others as they are."""
    cut = substrings.remove_repeats(docs, extra=["lang", "source"], as_is=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their place in sequences of 2048."""
    return queries.packed_documents(docs, ids=True)


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_known_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints, learned models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
