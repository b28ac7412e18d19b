"""The corpus pipeline: language ID, quality rules, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents. Between stages the rows are written as Parquet in the cluster's shared folder and read again,
so that a lost executor never sends the work back to an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelscribe.llm import jaccard, language_id, packing, quality, substrings
from reelscribe.plans.storage import kept


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one below a score of one half, go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return quality.keep_sound(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near copies stays."""
    return jaccard.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that a smaller doc_id has too go from the texts."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identified),
    ("quality_rules", sound),
    ("near_copies", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed),
]
#: The stages count, score and pack tokens with trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
