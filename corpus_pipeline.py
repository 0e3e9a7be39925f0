"""A corpus cleaned and encoded: five stages over `documents`, each on all the one before it kept.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import bpe, decontaminate, frames, jaccard_join, suffix_dedup, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    model = toxicity.fit(docs, frames.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays."""
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again are cut out of the texts."""
    return suffix_dedup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window close to a benchmark item go."""
    return decontaminate.keep_clean(docs, frames.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    return bpe.encode_checked(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_group),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

# Trained weights, merges and suffix order have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frames.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
