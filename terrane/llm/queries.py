"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import read


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.language_model import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.html import extract_pages

    return extract_pages(read(spark, sf_dir, "pages"))


def op3_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.toxicity import score_documents

    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.mpeg_audio import media_digests

    return media_digests(read(spark, sf_dir, "documents"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.secrets import scan_documents

    return scan_documents(read(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.tokens import token_table

    return token_table(read(spark, sf_dir, "documents"), byte_tokenizer(), end_id=2)


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.near_dedup import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "exact_copies")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), word_tokenizer(), end_id=2, size=4096)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.decontamination import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10, k=6)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
