"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents become one row per distinct length, by partial sums; everything after that works on
the histogram, whose size is bounded by the longest document and not by their number. With
the documents and tokens at each length or beyond, any context limit is answered exactly:
sum(min(length, limit)) = total - tokens beyond the limit + limit * documents beyond it.

Defined results: a null or empty text has length 0 and counts as a document; repeated rows
count each; an empty table has an empty histogram, no answers for limits, and null quantiles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import bpe

LENGTHS_PER_BLOCK = 1024


def encoded_lengths(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every document."""

    def columns(tools, texts, coded):
        return {"n_tokens": pa.array([len(ids) // 4 for ids in coded], pa.int64())}

    return bpe.map_texts(docs, rank_path, pattern, "doc_id long, n_tokens long", columns)


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs, one row per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds to each length: documents and tokens at it or beyond, totals, and the answers.

    truncated_tokens is the total when every document is cut to n_tokens; docs_share the share
    of documents no longer than n_tokens. Lengths are summed within blocks, then over blocks.
    """
    block = F.floor(F.col("n_tokens") / LENGTHS_PER_BLOCK)
    counts = counts.select("n_tokens", "n_docs", block.alias("block"))
    weights = {"docs": F.col("n_docs"), "tokens": F.col("n_docs") * F.col("n_tokens")}
    per_block = counts.groupBy("block").agg(*(F.sum(w).alias(f"block_{k}") for k, w in weights.items()))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = per_block.select(
        "block",
        *(F.coalesce(F.sum(f"block_{k}").over(beyond), F.lit(0)).alias(f"{k}_beyond") for k in weights),
        *(F.sum(f"block_{k}").over(everything).alias(f"total_{k}") for k in weights),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    at_least = {k: F.sum(w).over(within) + F.col(f"{k}_beyond") for k, w in weights.items()}
    return (
        counts.join(bases, "block")
        .select(
            "n_tokens",
            "n_docs",
            *(column.alias(f"{k}_at_least") for k, column in at_least.items()),
            "total_docs",
            "total_tokens",
        )
        .withColumn(
            "truncated_tokens",
            F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens"),
        )
        .withColumn("docs_share", 1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("total_docs"))
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_truncated, truncated_tokens and lost_tokens for each given limit."""
    beyond = F.col("n_tokens") > F.col("context_limit")
    answers = (
        sums.withColumn("context_limit", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))))
        .groupBy("context_limit")
        .agg(
            # what lies beyond a limit is what the shortest length beyond it has at it or further on
            F.coalesce(F.max(F.when(beyond, F.col("docs_at_least"))), F.lit(0)).alias("docs_truncated"),
            F.coalesce(F.max(F.when(beyond, F.col("tokens_at_least"))), F.lit(0)).alias("tokens_beyond"),
            F.max("total_tokens").alias("total_tokens"),
        )
    )
    kept = F.col("total_tokens") - F.col("tokens_beyond") + F.col("context_limit") * F.col("docs_truncated")
    return answers.select(
        "context_limit",
        "docs_truncated",
        kept.alias("truncated_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """One row: for each share, the smallest length that at least this share of documents has or is below."""
    return sums.agg(
        *(F.min(F.when(F.col("docs_share") >= q, F.col("n_tokens"))).alias(f"q{q}".replace(".", "_")) for q in shares)
    )
