"""From raw documents to an ordered training mix: five stages, each an operator of
``docreg.llm``. A stage works on all that its predecessor kept; what it rejects is
gone for the stages after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.llm import curriculum, decontamination, near_dedup, quality, toxicity
from docreg.llm.base import fold, table

#: Shingles of five words, similarity of 0.8 or more.
NEAR = near_dedup.Plan(words=5, percent=80)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs, NEAR)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with the words and the position of every
    copy, in training order of the first."""
    return curriculum.mix_digest(docs, "copies")


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_dedup", distinct_documents),
    ("decontamination", unseen_documents),
    ("mix", mixed_documents),
]
#: Two stages are fitted models; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
