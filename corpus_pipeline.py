"""A training corpus from the documents table, in five stages.

Language identification drops what has no language; the n-gram Jaccard join
keeps one document of each group of near copies; substring dedup cuts passages
that an earlier document has; mixing repeats and samples the documents towards
the sources' weights; packing deals the tokens to sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import folds, jaccard, langid, mixing, packing, runtime, substring


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language's profile, go."""
    runtime.ship(spark)
    return langid.recognised(docs, langid.learn(docs.where(~folds.held_out(F.col("doc_id")))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by similarity, one of the least identifier stays."""
    runtime.ship(spark)
    return jaccard.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of an earlier document go, and documents of which nothing is left."""
    runtime.ship(spark)
    return substring.without(docs, runtime.cut(substring.repeats(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place there."""
    runtime.ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", language), ("jaccard_join", near_copies), ("substring_dedup", passages), ("mix_sources", mixture), ("best_fit_packing", sequences)]

#: Stages run models and token vocabularies that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = runtime.fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
