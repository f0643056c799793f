"""The corpus pipeline: five stages, each an operator of ``tallyforge.llm`` over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from tallyforge.llm.common import read, release, staged_alone


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of equal texts, the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks for: never, once or twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document taken: doc_id, n_tokens and the digests of its ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The stages of signatures, draws and encoding can't be said in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged_alone(lambda f=stage, d=docs: f(spark, d, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
