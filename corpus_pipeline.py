"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from eventloom.llm.common import arrow_rows, discard, keep, passing
from eventloom.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or too short to tell languages apart, go."""
    # Texts may be long: fewer at a time for Python, in this write only.
    with arrow_rows(spark, 1_000):
        return keep(language_id.keep_languages(docs, language_id.train(docs)), "known-language")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest doc_id stays."""
    index = exact_dedup.new_index(spark)
    try:
        return exact_dedup.deduplicate(docs, index)
    finally:
        index.drop()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each class of near copies stays."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents with their sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Trained models and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what stages and their operators wrote on the way is deleted."""
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with passing(spark):
            done = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
        if docs is not given:
            discard(docs)
        docs = done
    return docs
