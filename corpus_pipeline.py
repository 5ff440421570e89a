"""The corpus pipeline: quality rules, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import langid, near_copies, packing, quality_ledger, suffix_dedup, tokens
from strandframe.llm.common import stored

#: Repeated strings of so many bytes go: nearly all passages of over 50 words have them.
PASSAGE_BYTES = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_ledger.kept_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; learned from the labelled ones that aren't held out."""
    return langid.known_documents(docs, langid.fit(docs.where(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8."""
    return near_copies.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that repeat."""
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, tokens.default_path("byte_bpe_50k.json"), keep=False)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: Trained models, connected components and tokenizers aren't SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
