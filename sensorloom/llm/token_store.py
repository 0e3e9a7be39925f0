"""Token ids in Parquet files laid out for selective reads.

Documents are dealt by ranges of doc_id, so that the files in the order of their shard number
hold ascending ids, and each shard is sorted. A row holds the ids as a list column next to
small metadata columns:

- `ids` is dictionary-encoded (a vocabulary fits in one dictionary page; beyond it the writer
  falls back to delta packing), doc_id, n_tokens and start_in_shard are delta-packed;
- row groups and pages have fixed target sizes and the writer adds page indexes, so reading the
  metadata touches no token page and a range of doc_id touches few pages of `ids`.

A text is cut at white space and each distinct word is encoded once per worker by the tokenizers
library: the tokenizer here never merges over white space, and its normaliser keeps it.

Defined results: a null text is an empty one and has the end id alone; null doc_ids come first;
repeated doc_ids follow one another in the order of their texts; other columns are not kept.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm import frames, words

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
GENERATION_WORDS = 400_000
RUN_WORDS = 200
BLOCK_BYTES = 4 << 20  # texts encoded together; a longer text is alone
KEPT_WORD_BYTES = 64

_SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens long, ids array<int>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# ASCII punctuation can close a word; not the apostrophe, which can start a piece with letters
_PUNCTUATION = np.array([b < 128 and chr(b) != "'" and chr(b).isprintable() and not chr(b).isalnum() for b in range(256)])
_PUNCTUATION[0x20] = False
_LETTER_OR_DIGIT = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def closed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block of texts in lower case, with a space before the punctuation that closes a word.

    Only ASCII is lower-cased, where no case depends on what follows; the normaliser does the rest.
    """
    data = _LOWER[data]
    marks = np.concatenate([[False], _PUNCTUATION[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[1:-1]] = True
    change = (marks[1:] != marks[:-1]) | cut
    starts = np.flatnonzero(change[:-1] & marks[1:-1])
    ends = np.flatnonzero(change[1:] & marks[1:-1]) + 1
    after_letter = (starts > 0) & ~cut[starts]
    after_letter[after_letter] = _LETTER_OR_DIGIT[data[starts[after_letter] - 1]]
    before_space = (ends == len(data)) | cut[ends]
    before_space[~before_space] = _WHITE[data[ends[~before_space]]]
    places = starts[after_letter & before_space]
    return np.insert(data, places, 0x20), offsets + np.searchsorted(places, offsets)


class WordEncoder:
    """Encodes blocks of UTF-8 texts word by word; ids come as unsigned 32-bit integers.

    A text is cut at ASCII white space, and where ASCII letters or digits meet a word's closing
    ASCII punctuation: the tokenizer cuts there as well. Words of letters alone go to the library
    many at a time: each is one run of ids whose last token carries the end-of-word mark; where
    the ends do not match the words, each word goes by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; idle threads would spin
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        mark = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if mark:
            self._ends[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        """Drop the words known so far."""
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _library(self, words: list[bytes]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast([word.decode() for word in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters alone, taken from runs of many words.

        Each word has at least one end, so as many ends as words mean one for each.
        """
        runs = [words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]
        joined = [b" ".join(run).decode() for run in runs]
        coded: list[bytes] = []
        for run, found in zip(runs, self._tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(ends) == len(run):
                data, ends = ids.tobytes(), ends.tolist()
                coded += [data[low:high] for low, high in zip([0, *ends[:-1]], ends)]
            else:
                coded += self._library(run)
        return coded

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each word. Words are known for two generations: used ones move to the younger."""
        young, old = self._young, self._old
        missing = [word for word in distinct if word not in young]
        if old:
            young.update([(word, old[word]) for word in missing if word in old])
            missing = [word for word in missing if word not in old]
        letters = [word for word in missing if word.isalpha() or word.decode().isalpha()]
        others = [word for word in missing if not (word.isalpha() or word.decode().isalpha())]
        young.update(zip(letters, self._letters(letters)))
        young.update(zip(others, self._library(others)))
        found = list(map(young.__getitem__, distinct))
        for word in missing:
            if len(word) > KEPT_WORD_BYTES:
                del young[word]
        if len(young) > GENERATION_WORDS:
            self._old, self._young = young, {}
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, one after the other, and where each text's end.

        Each distinct word of the block is looked up once; its ids are gathered for every place.
        """
        data, offsets = closed_words(data, offsets)
        found = words.find_words(data, offsets)
        cuts = np.concatenate([[0], np.cumsum(found.ends - found.starts)]).astype(np.int32)
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(data[~_WHITE[data]])]
        coded = pa.Array.from_buffers(pa.binary(), len(found.starts), buffers).dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        size = sizes[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        gathered = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first[place] - ends + size, size) + np.arange(total)]
        return gathered, np.concatenate([[0], ends])[found.first[1:]]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> None:
    """Encode every text, append the end id, and write the shards."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, tools = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            for first, data, offsets in words.text_blocks(batch.column("text"), BLOCK_BYTES):
                ids, ends = tools.encode(data, offsets)
                ids = np.insert(ids, ends, end_id).astype("<i4")
                ends = ends + np.arange(1, len(ends) + 1)
                sizes = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), shard, np.int32)),
                        batch.column("doc_id").slice(first, len(ends)),
                        pa.array(start + ends - sizes),
                        pa.array(sizes),
                        lists,
                    ],
                    names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids"],
                )
                start += int(ends[-1])
        tools.forget()

    (
        docs.selectExpr("cast(doc_id as long) doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(convert, _SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#start_in_shard", "false")
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of written shards.

    Needs no shuffle of documents: a shard's base is the sum over the shards before it. There
    is one base for each written file, the bound of what is broadcast.
    """
    stored = spark.read.schema(_SCHEMA).parquet(folder)
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total")).collect()
    base, bases = 0, []
    for shard, total in sorted(tuple(row) for row in totals):
        bases.append((shard, base))
        base += total
    bases = spark.createDataFrame(bases, "shard int, base long")
    return stored.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids"
    )


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of a frame that `read` returned."""

    def convert(batch):
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("start"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return frames.map_batches(
        stored.select("doc_id", "start", "ids"), convert, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
