"""Importance resampling towards a target distribution, by hashed runs of words.

Words are lower-cased (A-Z only) runs of letters, digits and non-ASCII characters. Features are
all runs of one to `longest` words joined by one space, counted in buckets by their crc32. The
log ratio of a bucket's share in the target to its share in the documents is its gain; a
document's weight is the sum of its features' gains, and adding Gumbel noise that depends on the
id alone makes the highest scores a sample without replacement in proportion to the weights.

- Scanning: separators become single spaces, and one overlapped pass of the pattern for n words,
  with look-arounds for the spaces at both ends, gives the span of every run of n words in the
  bytes as they stand. The crc32 of all spans is taken together, byte by byte, in numpy: no
  feature becomes a string.
- Each text is scanned once. Its bucket numbers are written, 14 bits each before compression;
  counts, gains and weights come from them. What reaches the driver is one count for each
  bucket, a fixed number.
- Ranks come from ranges of (score, id): each range numbers its rows and starts after the
  sizes of the ranges before it, so no task sees all rows.

Defined results: a null or wordless text has no features and weight 0; it can be drawn only if
it has enough words; each row is a document, so a repeated row is scored again with the same
noise; a null id has the noise of an empty id and comes last among ties; rows equal in score
and id are ranked in any order (by their features first); an empty target gives gains from the
documents alone; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

_BLOCK_BYTES = 1 << 20
_LONG_SPAN = 64  # longer spans are hashed one by one
_SPACES = re.compile(rb"  +")
_span = methodcaller("span")


def _separators() -> bytes:
    """Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space."""
    table = bytearray(range(256))
    for byte in range(128):
        table[byte] = ord(chr(byte).lower()) if chr(byte).isalnum() else 0x20
    return bytes(table)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_PLAIN, _CRC = _separators(), _crc_table()


@lru_cache(maxsize=16)
def run_pattern(size: int) -> regex.Pattern:
    """Matches `size` words between spaces; texts are kept apart by line feeds."""
    return regex.compile(rb"(?<= )[^ \n]+(?: [^ \n]+){%d}(?= )" % (size - 1))


def crc32_of_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each data[start:end]."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, sizes = starts[order], sizes[order]
    codes = np.frombuffer(data, np.uint8)
    sums = np.full(len(at), 0xFFFFFFFF, np.uint32)
    longer = int(np.searchsorted(-sizes, -_LONG_SPAN, "left"))
    active = np.searchsorted(-sizes, -np.arange(_LONG_SPAN), "left")
    for step in range(_LONG_SPAN):
        some = slice(longer, int(active[step]))
        if some.stop <= longer:
            break
        part = sums[some]
        sums[some] = _CRC[(part ^ codes[at[some] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
    sums ^= np.uint32(0xFFFFFFFF)
    for i in range(longer):
        sums[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    result = np.empty_like(sums)
    result[order] = sums
    return result


def bucketed(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature by text, where each text's begin (one entry more), and words of each text."""
    parts = [_SPACES.sub(b" ", b" " + text.translate(_PLAIN) + b" ") for text in texts]
    data = b"\n".join(parts)
    firsts = np.cumsum([0] + [len(part) + 1 for part in parts])
    rows, found, counts = [], [], None
    for size in range(1, longest + 1):
        matches = run_pattern(size).finditer(data, overlapped=True)
        spans = np.fromiter(chain.from_iterable(map(_span, matches)), np.int64).reshape(-1, 2)
        rows.append(np.searchsorted(firsts, spans[:, 0], "right") - 1)
        found.append(crc32_of_spans(data, spans[:, 0], spans[:, 1]) % buckets)
        if counts is None:
            counts = np.bincount(rows[0], minlength=len(texts))
    row, bucket = np.concatenate(rows), np.concatenate(found).astype(np.int32)
    if longest > 1:
        bucket = bucket[np.argsort(row, kind="stable")]
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    return bucket, np.concatenate([[0], ends]), counts


def features(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words and buckets (one entry for each feature) of every text."""

    def convert(batch):
        for first, data, offsets in words.text_blocks(batch.column("text"), _BLOCK_BYTES):
            raw, at = data.tobytes(), offsets.tolist()
            bucket, ends, counts = bucketed([raw[a:b] for a, b in zip(at[:-1], at[1:])], buckets, longest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(at) - 1),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bucket)),
                ],
                names=["doc_id", "n_words", "buckets"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    return frames.map_batches(rows, convert, "doc_id long, n_words long, buckets array<int>")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: as many numbers as buckets."""
    counts = np.zeros(buckets, np.int64)
    for bucket, count in found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        counts[bucket] = count
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    size = float(len(source))
    inside, wanted = float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (inside + size) / ((s + 1.0) * (wanted + size))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight."""

    def convert(batch):
        buckets = batch.column("buckets")
        ends = buckets.offsets.to_numpy()
        sums = np.concatenate([[0], np.cumsum(gain[buckets.values.to_numpy(zero_copy_only=False)])])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64)),
            ],
            names=["doc_id", "n_words", "n_features", "weight"],
        )

    return frames.map_batches(found, convert, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Gumbel noise in thousandths, rounded down, from the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))


def _numbered(scored: DataFrame) -> DataFrame:
    """The rows with rank: 1 for the highest score, ties to the smaller id."""
    schema = "doc_id long, n_features long, weight long, score long, part int, place long"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = np.arange(place + 1, place + 1 + batch.num_rows)
            place += batch.num_rows
            columns = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "place"])

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = (
        scored.select("doc_id", "n_features", "weight", "score")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(convert, schema)
    )
    placed = frames.written(placed, "ranks")
    sizes = sorted(tuple(row) for row in placed.groupBy("part").count().collect())  # one for each range
    before = np.cumsum([0] + [size for _, size in sizes]).tolist()
    bases = [(part, base) for (part, _), base in zip(sizes, before)]
    bases = placed.sparkSession.createDataFrame(bases, "part int, base long")
    return placed.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("place"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    target_key: str = "item_id",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn, else null) of every document.

    Of the documents with at least `least_words` words, `percent` in a hundred are drawn.
    """
    found = frames.written(features(docs, buckets, longest), "buckets")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, buckets, longest, target_key), buckets))
    scored = frames.written(weighted(found, gain).withColumn("score", F.col("weight") + noise(seed)), "scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    ranked = _numbered(eligible).select(*names, rank.alias("rank"))
    others = scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)


def sample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """doc_id and rank of the drawn documents."""
    return resample(docs, target, **parameters).where("rank IS NOT NULL").select("doc_id", "rank")
