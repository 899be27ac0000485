"""The document pipeline: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import contract, lines, mixing, neardup, packing, quality
from linkloom.scratch import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``docs``, doesn't call good go."""
    return quality.keep_good(docs, quality.fit(docs, contract.training_labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines, short ones too, that repeat an earlier line; a text that loses every line goes."""
    return lines.drop_repeated_lines(docs, short=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Those are all that SimHash links, and those that have a Jaccard similarity of 0.8 on five words.
    """
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the token budget of their source go; nine tenths of the tokens are shared out."""
    return mixing.keep_mixed(docs, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS, (9, 10))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a bin of 2,048 tokens."""
    return packing.pack(docs, packing.copies(F.col("text")))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_documents),
]

#: The classifier compresses texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda held, stage: written(stage[1](spark, held, sf_dir), "stage"), STAGES, docs)
