"""Named queries of the operators here: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import bpe, decontaminate, divergence, importance, jaccard_join, langid, line_dedup, quality_lines
from sensorloom.llm import suffix_dedup, token_counts, token_store, toxicity, warc
from sensorloom.llm.frames import shared_folder, table, written

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return bpe.encode_checked(docs, RANKS, public_tokenizers.PATTERN, with_ids=False)


def op2_langid(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_quality_lines(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    field = quality_lines.fit(docs, table(spark, directory, "labels"))
    return quality_lines.assess(docs, field)


def op4_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard_join.connect(table(spark, directory, "documents")).drop("row_key")


def op5_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, directory, "labels")))


def op6_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, directory, "documents"))


def op7_token_store(spark: SparkSession, directory: str) -> DataFrame:
    folder = shared_folder(spark, "token-store")
    token_store.write(table(spark, directory, "documents"), WORD_TOKENIZER, folder)
    return token_store.digests(token_store.read(spark, folder))


def op8_warc(spark: SparkSession, directory: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    records = warc.archive(spark, table(spark, directory, "pages"), folder)
    return records.drop("url")


def op9_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op10_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    lengths = token_counts.encoded_lengths(docs, RANKS, public_tokenizers.PATTERN)
    counts = written(token_counts.histogram(lengths), "histogram")  # small, and read twice from here on
    return token_counts.suffix_sums(counts)


def op11_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup(table(spark, directory, "documents")))


def op12_importance(spark: SparkSession, directory: str) -> DataFrame:
    return importance.resample(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op13_divergence(spark: SparkSession, directory: str) -> DataFrame:
    return divergence.audit(table(spark, directory, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_byte_bpe": op1_byte_bpe,
        "op2_langid": op2_langid,
        "op3_quality_lines": op3_quality_lines,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_toxicity": op5_toxicity,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_token_store": op7_token_store,
        "op8_warc": op8_warc,
        "op9_decontaminate": op9_decontaminate,
        "op10_token_counts": op10_token_counts,
        "op11_line_dedup": op11_line_dedup,
        "op12_importance": op12_importance,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    stated = {"op11_line_dedup": line_dedup.SQL, "op13_divergence": divergence.SQL}
    return stated | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
