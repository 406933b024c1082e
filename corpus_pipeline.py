"""From raw documents to tokens: a pipeline of five of the corpus operators.

Each stage gets the documents that the one before it kept, written as Parquet and read again. All stages but the last return the
columns of their input, whatever their names; an empty table gives an empty one. Null and empty texts count as texts without
words. Rows without an id are judged by their text alone and never stand for copies of each other in near_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import classifier, mixing, pieces, simhash, substrings
from tidewell.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it is trained on those of docs that have labels. Equal rows are
    judged alike; null columns count as empty; where labels are missing in a fold nothing is rejected."""
    return classifier.accepted(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Of rows that repeat an id and a text one stays;
    wordless documents are one group."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that lie in an earlier document, by id; rows stay, with what is left of their texts."""
    return substrings.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target shares; a null source is one of its own, and one
    without a word has no copies. Equal rows are decided alike."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, a row a row."""
    return pieces.encode(docs)


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixture), ("sentencepiece", tokens)]

#: The classifier and the tokenizer can't be told in SQL; tests hold the pipeline against its own operators instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
