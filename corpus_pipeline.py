"""A pipeline over the documents table: each stage's result is stored and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import discard, read, stored
from terrane.llm.decontamination import without_contaminated
from terrane.llm.near_dedup import one_of_each
from terrane.llm.packing import pack_documents
from terrane.llm.queries import word_tokenizer
from terrane.llm.secrets import redacted
from terrane.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field model takes for toxic go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, word_tokenizer(), end_id=2, size=4096)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The stages' models and fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
