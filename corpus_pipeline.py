"""Stages that turn the raw documents into packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` with all that its predecessor kept.  All but the
last return the columns of ``documents``; ``n_chars`` is that of the text they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bag_minhash, packing, quality_mcd, unit_dedup
from loomgraph.llm.shared import named, tokenizer_path, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie beyond the robust estimate of their language and source go."""
    return quality_mcd.judge(docs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id."""
    return bag_minhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that an earlier document holds go from the texts."""
    removed = "removed"
    while removed in docs.columns:
        removed += "_"
    kept = unit_dedup.remove_repeats(docs, removed=removed)
    gone = F.size(removed) > 0
    return kept.select(
        *[F.when(gone, F.char_length("text").cast("bigint")).otherwise(named(c)).alias(c) if c == "n_chars" else named(c) for c in docs.columns]
    )


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings), ("best-fit packing", best_fit)]

#: Signatures and packing by a genetic algorithm have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
    return docs
