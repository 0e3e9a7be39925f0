"""Byte-level BPE encoding and decoding by a rank file.

The merges run in the tokenizers library, over Arrow batches. A text is cut at single spaces
and the words that are not known yet are cut by the split pattern, all at once; the library sees
each distinct piece of them. Ids are held as little-endian 32-bit integers, so that a text's ids
are the joined bytes of its words' ids; digits and decoded bytes are gathered from tables.
Known words are kept in two generations of bounded bytes: what is used moves to the younger one,
which replaces the older when full. A task forgets them when it ends, so idle workers hold none.
Rank files list tokens, not merges: every way to cut a token into two tokens becomes a merge of
that token's rank.

The library orders merges by their place in the list, a rank file by the rank of the result
and then by position. Both agree unless three neighbours x y z have x+y == y+z as strings, so
pieces that contain such an x+y+z (a few hundred strings, found from the ranks) are merged by
a heap over (rank, position) instead.

Defined results: a null text is an empty one; an empty text has no ids and decodes to no
bytes. Repeated rows give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from sensorloom.llm import frames

GENERATION_BYTES = 8 << 20
ENTRY_BYTES = 200  # a short word and its ids, as objects in a dictionary
KEPT_WORD_BYTES = 64
GATHERED_IDS = 1 << 18
_WIDE_SPACE = re.compile(r" \s|[^\S ] ")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed rule of such vocabularies: the printable Latin-1 characters stand for themselves
    and the other bytes, in order, for the characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    place = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
    return [chr(place[b]) for b in range(256)]


class Codec:
    """Encoder and decoder of one rank file; built once per worker."""

    def __init__(self, rank_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; idle threads would spin
        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self._decimal = _Table({rank: b",%d" % rank for rank in self.token_bytes})
        self._bytes = _Table(self.token_bytes)
        self.forget()

    def forget(self) -> None:
        """Drop the words known so far."""
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _cuts(self) -> list[tuple[int, bytes, bytes]]:
        """Rank and both parts of every merge; not kept, as they take more memory than the ranks."""
        cuts = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = token[:i], token[i:]
                if left in self.ranks and right in self.ranks:
                    cuts.append((rank, left, right))
        return sorted(cuts)

    @cached_property
    def _tokenizer(self) -> Tokenizer:
        characters = byte_characters()
        written = {token: "".join(characters[b] for b in token) for token in self.ranks}
        model = models.BPE(
            vocab={written[token]: rank for token, rank in self.ranks.items()},
            merges=[(written[left], written[right]) for _, left, right in self._cuts()],
            ignore_merges=True,
        )
        tokenizer = Tokenizer(model)
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return tokenizer

    @cached_property
    def _ambiguous(self):
        """Finds the strings in which two overlapping pairs would make the same token."""
        by_token: dict[bytes, list[int]] = {}
        for _, left, right in self._cuts():
            by_token.setdefault(left + right, []).append(len(left))
        automaton = ahocorasick.Automaton()
        for token, cuts in by_token.items():
            for i in cuts:
                for k in cuts:
                    if i != k and token[i:] == token[:k]:
                        automaton.add_word((token + token[k:]).decode("latin-1"), 1)
        if not len(automaton):
            return None
        automaton.make_automaton()
        return automaton

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """The lowest rank first, the leftmost of equals, by a heap over neighbouring pairs."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        count = len(piece)
        end = list(range(1, count + 1))  # where the part that starts here ends; 0 when merged
        before = list(range(-1, count - 1))
        heap = []

        def offer(left: int) -> None:
            if left >= 0 and end[left] < count:
                stop = end[end[left]]
                rank = self.ranks.get(piece[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end[left], stop))

        for i in range(count - 1):
            offer(i)
        while heap:
            _, left, middle, stop = heapq.heappop(heap)
            if end[left] != middle or end[middle] != stop:
                continue
            end[left], end[middle] = stop, 0
            if stop < count:
                before[stop] = left
            offer(before[left])
            offer(left)
        ids, at = [], 0
        while at < count:
            ids.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return tuple(ids)

    def _ambiguous_among(self, pieces: list[bytes]) -> set[int]:
        """Places of the pieces that the library might merge in another order."""
        if not self._ambiguous:
            return set()
        joined = "\u0100".join(piece.decode("latin-1") for piece in pieces)
        ends = np.cumsum([len(piece) + 1 for piece in pieces])
        return set(np.searchsorted(ends, [at for at, _ in self._ambiguous.iter(joined)], "right").tolist())

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each distinct piece."""
        raw = [piece.encode() for piece in pieces]
        own = self._ambiguous_among(raw)
        learnt = {pieces[i]: np.array(self._merge(raw[i]), "<i4").tobytes() for i in own}
        plain = [piece for i, piece in enumerate(pieces) if i not in own] if own else pieces
        if plain:
            # one input of many pieces, merged within each; sizes in bytes tell whose the ids are
            coded = self._tokenizer.encode_batch_fast([plain], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(coded.ids, "<i4")
            data = ids.tobytes()
            sizes = np.cumsum([len(piece.encode()) for piece in plain])
            ends = (4 * (np.searchsorted(np.cumsum(self._bytes.sizes[ids]), sizes) + 1)).tolist()
            learnt.update(zip(plain, [data[low:high] for low, high in zip([0, *ends], ends)]))
        return learnt

    def _cut(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word, which stands behind a space."""
        pieces = self.split.findall("".join([" " + word for word in words]))
        starts = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        if len(starts) != len(words):
            return [self.split.findall(" " + word) for word in words]
        return [pieces[low:high] for low, high in zip(starts, [*starts[1:], len(pieces)])]

    def _ids_of(self, cut: list[list[str]]) -> list[bytes]:
        ids = self._learn(list(set(chain.from_iterable(cut))))
        return [ids[parts[0]] if len(parts) == 1 else b"".join([ids[piece] for piece in parts]) for parts in cut]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers.

        A space between two characters that are no white space always starts a piece, so a
        text is cut there first and its words, each taken with its space, are looked up.
        """
        cut = [
            None if text[:1] == " " or text[-1:] == " " or _WIDE_SPACE.search(text) else text.split(" ") for text in texts
        ]
        heads = self._ids_of([self.split.findall(text if words is None else words[0]) for text, words in zip(texts, cut)])
        wanted = set().union(*(words[1:] for words in cut if words is not None))
        young, old = self._young, self._old
        missing = wanted - young.keys()
        known = missing & old.keys()
        missing -= known
        young.update([(word, old[word]) for word in known])
        # white space at a word's end, where a text ends, would meet the next word's space
        closed = [word for word in missing if not word[-1].isspace()]
        open_ended = [word for word in missing if word[-1].isspace()]
        young.update(zip(closed, self._ids_of(self._cut(closed))))
        young.update(zip(open_ended, self._ids_of([self.split.findall(" " + word) for word in open_ended])))
        get = young.__getitem__
        coded = [
            head if words is None or len(words) == 1 else head + b"".join(map(get, words[1:]))
            for head, words in zip(heads, cut)
        ]
        for word in missing:
            if len(word) > KEPT_WORD_BYTES:
                del young[word]
        if len(young) * ENTRY_BYTES > GENERATION_BYTES:
            self._old, self._young = young, {}
        return coded

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [np.frombuffer(data, "<i4").tolist() for data in self.encode_bytes(texts)]

    def decode(self, ids) -> bytes:
        """The bytes of the ids; characters split over tokens come out whole."""
        return b"".join(self._bytes.parts(np.asarray(ids, np.int64)))

    def decimal(self, ids) -> str:
        """The ids in decimal, joined by commas."""
        return b"".join(self._decimal.parts(np.asarray(ids, np.int64)))[1:].decode()

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """sha256 of the ids in decimal, joined by commas, and of the bytes they decode to."""
        decimal, decoded = hashlib.sha256(), hashlib.sha256()
        for number, part in enumerate(self._decimal.parts(ids)):
            decimal.update(part if number else part[1:])
        for part in self._bytes.parts(ids):
            decoded.update(part)
        return decimal.hexdigest(), decoded.hexdigest()

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """The character range each id touches; ids that share a character overlap there."""
        raw = text.encode()
        starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # 1-based character
        sizes = np.fromiter((len(self.token_bytes[i]) for i in ids), np.int64, len(ids))
        ends = np.cumsum(sizes)
        return [(int(starts[e - n]) - 1, int(starts[e - 1])) for e, n in zip(ends, sizes)]


class _Table:
    """A string of bytes for each id, laid end to end."""

    def __init__(self, strings: dict[int, bytes]):
        sizes = np.zeros(max(strings, default=-1) + 1, np.int64)
        for number, string in strings.items():
            sizes[number] = len(string)
        self.sizes, self._starts = sizes, np.cumsum(sizes) - sizes
        self._data = np.frombuffer(b"".join(strings[number] for number in sorted(strings)), np.uint8)

    def parts(self, ids: np.ndarray) -> Iterator[bytes]:
        """The strings of the ids, one after the other, a bounded number at a time."""
        for low in range(0, len(ids), GATHERED_IDS):
            some = ids[low : low + GATHERED_IDS]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            yield self._data[np.repeat(self._starts[some] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=4)
def codec(rank_path: str, pattern: str) -> Codec:
    return Codec(rank_path, pattern)


def runs(column: pa.Array, rows: int = 256, size: int = 1 << 21):
    """Cut a text column into runs of whole rows, bounded in rows and bytes; null is empty."""
    first, run, held = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        run.append(text)
        held += len(text)
        if len(run) >= rows or held >= size:
            yield first, run
            first, run, held = i + 1, [], 0
    if run:
        yield first, run


def id_lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(data) // 4 for data in coded])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def map_texts(docs: DataFrame, rank_path: str, pattern: str, schema: str, columns) -> DataFrame:
    """Encode every text; `columns` makes the columns behind doc_id of (codec, texts, their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = codec(rank_path, pattern)
        try:
            for batch in batches:
                for first, texts in runs(batch.column("text")):
                    made = columns(tools, texts, tools.encode_bytes(texts))
                    ids = batch.column("doc_id").slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([ids, *made.values()], names=["doc_id", *made])
        finally:
            tools.forget()
            frames.give_back()

    return frames.small_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, schema)


def encode(docs: DataFrame, rank_path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with offsets also starts and ends in characters."""
    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if with_offsets else "")

    def columns(tools, texts, coded):
        made = {"ids": id_lists(coded)}
        if with_offsets:
            ranges = [tools.offsets(text, np.frombuffer(data, "<i4").tolist()) for text, data in zip(texts, coded)]
            for k, name in enumerate(("starts", "ends")):
                made[name] = pa.array([[r[k] for r in row] for row in ranges], pa.list_(pa.int32()))
        return made

    return map_texts(docs, rank_path, pattern, schema, columns)


def decode(coded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, data binary and text of doc_id, ids; bytes that are no UTF-8 give a null text."""

    def convert(batch):
        tools = codec(rank_path, pattern)
        data = [tools.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(data, pa.binary()), pa.array(map(_text, data), pa.string())],
            names=["doc_id", "data", "text"],
        )

    return frames.map_batches(coded.select("doc_id", "ids"), convert, "doc_id long, data binary, text string")


def _text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def encode_checked(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode and decode the ids again: doc_id, n_tokens, digests of ids and decoded bytes, and the ids."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def columns(tools, texts, coded):
        digests = [tools.digests(np.frombuffer(data, "<i4").astype(np.int64)) for data in coded]
        made = {
            "n_tokens": pa.array([len(data) // 4 for data in coded], pa.int64()),
            "ids_sha256": pa.array([ids for ids, _ in digests], pa.string()),
            "decoded_sha256": pa.array([decoded for _, decoded in digests], pa.string()),
        }
        return made | ({"ids": id_lists(coded)} if with_ids else {})

    return map_texts(docs, rank_path, pattern, schema, columns)
