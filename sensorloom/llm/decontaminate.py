"""Benchmark decontamination: windows of a document that nearly equal a benchmark item.

Texts are sequences of words (lower-cased runs of letters, digits and non-ASCII characters). A
document is contaminated by an item of m words when some window of it is within floor(0.2 * m)
word insertions, deletions and substitutions of the item.

- Blocks: an item is cut evenly into blocks of at most BLOCK_WORDS words. Of the k edits of a
  match, at least one block of L words has no more than k * L / m, so it is enough to find
  blocks, whatever the item's length.
- Windows: an unchanged run of ceil((L - k) / (k + 1)) words survives any k edits of a block, so
  only places that share such a run (of at most four words) with a block can hold it. Each
  shared run fixes where block-sized windows start. Windows of equal surroundings are one.
- Embedding: each window and block goes through CGK random walks: step j writes the current
  word and advances if a random bit of (j, word) says so. A few edits then change few of the
  written words.
- Hashing: pairs of steps are sampled among those in which the block writes, as many times as
  the target recall asks for at the least agreement expected within the edit limit. Windows
  are looked up in one table of blocks for each sample; one agreement makes a candidate.
- Verification: exact edit distance of the block to the best substring around the window, then
  of the whole item around where the block was found.

Windows and candidates are handled in runs of bounded size. Items are taken to the executors in
chunks of bounded size, one chunk at a time, whatever the benchmark's size; documents are not
shuffled. Recall is below one by design (the README has figures); reported pairs are true ones,
and `edits` is the least over the places verified.

Defined results: null, empty or wordless texts match nothing, on either side; items of fewer
than five words match only unchanged; a pair is reported once, with its best window, the first
of equals; `first_word` is where the shortest such window starts; repeated rows are reported each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words

EDIT_SHARE = 0.2
BLOCK_WORDS = 25
TARGET_RECALL = 0.999
LEAST_AGREEMENT = 0.3  # share of written words that matching blocks have in common
SAMPLED = 2  # steps per sample
WALKS = 4
SHIFTS = (0, -1, 1)
CHUNK_BYTES = 16 << 20
SEED = 20_011

_FILTER_BITS = 22
_RUN_OF_WINDOWS = 1 << 16
_COMPARED_WORDS = 1 << 20  # of the spans compared at once
_REACHES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48])  # steps to sample from: the most that a block writes
_BASE = 0x9E3779B97F4A7C15


def most_edits(size: int) -> int:
    return math.floor(EDIT_SHARE * size) if size >= 5 else 0


def run_width(size: int, edits: int) -> int:
    return min(4, math.ceil((size - edits) / (edits + 1)))


def blocks_of(size: int) -> list[tuple[int, int, int]]:
    """First word, number of words and most edits of each block of an item."""
    count = -(-size // BLOCK_WORDS)
    cuts = [size * i // count for i in range(count + 1)]
    return [(a, b - a, most_edits(size) * (b - a) // size) for a, b in zip(cuts[:-1], cuts[1:])]


def repetitions() -> int:
    """Samples needed for the target recall."""
    return math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - LEAST_AGREEMENT**SAMPLED))


def _text_words(texts: pa.Array):
    """Blocks of (first row, word hashes, words)."""
    for first, data, offsets in words.text_blocks(pc.utf8_lower(texts)):
        found = words.find_words(data, offsets, words.NOT_ALPHANUMERIC)
        yield first, words.word_hashes(data, found), found


def walk(sequence: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: int, number: int) -> np.ndarray:
    """The words that one CGK walk writes from each start; beyond a stop it writes zero."""
    written = np.zeros((steps, len(starts)), np.uint64)
    at = starts.copy()
    for j in range(steps):
        inside = at < stops
        current = np.where(inside, sequence[np.minimum(at, len(sequence) - 1)], np.uint64(0))
        written[j] = current
        salt = np.uint64((SEED + number * 1_000_003 + j) * _BASE % (1 << 64))
        at += (words.mix(current ^ salt) >> np.uint64(63)).astype(np.int64)
    return written


def best_distance(item: np.ndarray, spans: np.ndarray, anchored: bool = False) -> np.ndarray:
    """Least edits of the item to a substring of each span (a row of words) that ends at each place.

    Anchored substrings begin where the span does.
    """
    column = np.arange(spans.shape[1] + 1)
    row = np.tile(column if anchored else np.zeros(len(column), np.int64), (len(spans), 1))
    for i, word in enumerate(item, 1):
        step = np.empty_like(row)
        step[:, 0] = i
        step[:, 1:] = np.minimum(row[:, :-1] + (spans != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - column, axis=1) + column
    return row


class _Spans:
    """Stretches of words around places in a block of texts, cut at the ends of their rows."""

    def __init__(self, hashes: np.ndarray, found: words.Words):
        self.hashes, self.found = hashes, found
        powers = np.full(len(hashes) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self._inverse = np.full(len(hashes) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        self._inverse[0] = 1
        self._inverse = np.cumprod(self._inverse, dtype=np.uint64)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])

    def bounds(self, rows: np.ndarray, starts: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.maximum(starts - before, self.found.first[rows])
        return low, np.minimum(starts + after, self.found.first[rows + 1])

    def alike(self, rows: np.ndarray, starts: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct stretch, and which of them each place has."""
        low, high = self.bounds(rows, starts, before, after)
        content = words.mix((self._sums[high] - self._sums[low]) * self._inverse[low])
        keys = words.combine([content, (starts - low).astype(np.uint64), (high - starts).astype(np.uint64)])
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        return first, group

    def words(self, rows: np.ndarray, starts: np.ndarray, before: int, after: int) -> np.ndarray:
        low, high = self.bounds(rows, starts, before, after)
        place = starts[:, None] + np.arange(-before, after)
        inside = (place >= low[:, None]) & (place < high[:, None])
        return np.where(inside, self.hashes[np.clip(place, 0, len(self.hashes) - 1)], np.uint64(0))

    def distances(self, item: np.ndarray, rows, starts, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of the item to a substring of each stretch, and where it ends (a word of the block of texts)."""
        least, stop = np.zeros((2, len(rows)), np.int64)
        step = max(1, _COMPARED_WORDS // (before + after))
        for k in range(0, len(rows), step):
            some = slice(k, k + step)
            ends = best_distance(item, self.words(rows[some], starts[some], before, after))
            least[some], stop[some] = ends.min(1), ends.argmin(1)
        return least, starts - before + stop

    def sharing(self, item: np.ndarray, least: int, rows, starts, before: int, after: int) -> np.ndarray:
        """Whether each stretch has as many of the item's words: no fewer can be within the other edits."""
        enough = np.zeros(len(rows), bool)
        step = max(1, _COMPARED_WORDS // (len(item) * (before + after)))
        for k in range(0, len(rows), step):
            text = self.words(rows[k : k + step], starts[k : k + step], before, after)
            enough[k : k + step] = (text[:, None, :] == item[:, None]).any(2).sum(1) >= least
        return enough


class Items:
    """A chunk of the benchmark: its blocks, their runs of words, and a table of them for each sample."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: list = []
        self.sequences: list[np.ndarray] = []
        if rows:
            for first, hashes, found in _text_words(pa.array([text for _, text in rows], pa.string())):
                for i in np.flatnonzero(found.counts()):
                    self.ids.append(rows[first + i][0])
                    self.sequences.append(hashes[found.first[i] : found.first[i + 1]])
        self.blocks: list[tuple[np.ndarray, int]] = []  # distinct: words and most edits
        self.members: list[list[tuple[int, int]]] = []  # items that have the block, and where
        known: dict[tuple[bytes, int], int] = {}
        for item, sequence in enumerate(self.sequences):
            for first, size, edits in blocks_of(len(sequence)):
                block = sequence[first : first + size]
                number = known.setdefault((block.tobytes(), edits), len(self.blocks))
                if number == len(self.blocks):
                    self.blocks.append((block, edits))
                    self.members.append([])
                self.members[number].append((item, first))
        self._index_runs()
        self._index_samples()

    def _index_runs(self) -> None:
        """Distinct (run, place in its block), by width."""
        grams: dict[int, list] = {}
        for block, edits in self.blocks:
            width = run_width(len(block), edits)
            count = len(block) - width + 1
            grams.setdefault(width, []).append((words.combine([block[k : k + count] for k in range(width)]), np.arange(count)))
        self._runs = {}
        for width, parts in grams.items():
            hashes, places = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((places, hashes))
            hashes, places = hashes[order], places[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1])
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self._runs[width] = (hashes[fresh], places[fresh], seen)

    def _index_samples(self) -> None:
        """For each sample and reach: the sampled steps, and the blocks by what they write there."""
        self._tables: list[tuple[int, list[int], np.ndarray, np.ndarray]] = []
        if not self.blocks:
            return
        sequence = np.concatenate([block for block, _ in self.blocks])
        stops = np.cumsum([len(block) for block, _ in self.blocks])
        starts = stops - [len(block) for block, _ in self.blocks]
        rng = np.random.default_rng(SEED)
        shares = rng.random((repetitions(), SAMPLED))
        for number in range(WALKS):
            written = walk(sequence, starts, stops, int(_REACHES[-1]), number)
            reach = _REACHES[np.searchsorted(_REACHES, (written != 0).sum(0), "right") - 1]
            for steps in np.unique(reach):
                own = np.flatnonzero(reach == steps)
                for sample in range(number, repetitions(), WALKS):
                    at = (shares[sample] * steps).astype(np.int64).tolist()
                    keys = words.combine([written[j, own] for j in at])
                    order = np.argsort(keys, kind="stable")
                    self._tables.append((number, at, keys[order], own[order]))

    def _windows(self, spans: _Spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and first words of windows that share a run with some block, in runs of bounded size."""
        hashes, found = spans.hashes, spans.found
        for width, (known, places, seen) in self._runs.items():
            count = len(hashes) - width + 1
            if count <= 0:
                continue
            grams = words.combine([hashes[k : k + count] for k in range(width)])
            at = np.flatnonzero(seen[grams >> np.uint64(64 - _FILTER_BITS)])
            at = at[found.rows[at] == found.rows[at + width - 1]]
            low, high = np.searchsorted(known, grams[at]), np.searchsorted(known, grams[at], "right")
            at, low, sizes = at[high > low], low[high > low], (high - low)[high > low]
            # a run of words has at most BLOCK_WORDS places
            for k in range(0, len(at), _RUN_OF_WINDOWS // BLOCK_WORDS):
                some = slice(k, k + _RUN_OF_WINDOWS // BLOCK_WORDS)
                size = sizes[some]
                hit = np.repeat(low[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                begin = np.repeat(at[some], size)
                rows = found.rows[begin]
                begin = (begin - places[hit])[None, :] + np.array(SHIFTS)[:, None]
                begin = np.clip(begin, found.first[rows], found.first[rows + 1] - 1)
                starts = np.unique(begin)
                yield found.rows[starts], starts

    def _candidates(self, spans: _Spans, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks and the windows that agree with them in some sample."""
        stops = spans.found.first[rows + 1]
        written = [walk(spans.hashes, starts, stops, int(_REACHES[-1]), number) for number in range(WALKS)]
        agreed: dict[int, set[int]] = {}
        for number, at, keys, own in self._tables:
            sampled = words.combine([written[number][j] for j in at])
            low, high = np.searchsorted(keys, sampled), np.searchsorted(keys, sampled, "right")
            for window in np.flatnonzero(high > low).tolist():
                for block in own[low[window] : high[window]].tolist():
                    agreed.setdefault(block, set()).add(window)
        for block, windows in agreed.items():
            yield block, np.array(sorted(windows))

    def matches(self, hashes: np.ndarray, found: words.Words) -> list[tuple[int, int, int, int]]:
        """Row, item, edits and first word of each contaminated pair of a block of texts."""
        if not len(hashes):
            return []
        spans = _Spans(hashes, found)
        best: dict[tuple[int, int], tuple[int, int]] = {}  # row, item: edits and the word behind the match
        done: set[tuple[int, int, int]] = set()  # item, row and place: compared already
        reach = BLOCK_WORDS + most_edits(BLOCK_WORDS)
        for rows, starts in self._windows(spans):
            first, group = spans.alike(rows, starts, reach, 2 * reach)
            members = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[members], np.arange(len(first) + 1))
            for block, windows in self._candidates(spans, rows[first], starts[first]):
                sequence, edits = self.blocks[block]
                shape = (edits + 1, len(sequence) + 2 * edits + 1)
                kept = first[windows]
                windows = windows[spans.sharing(sequence, len(sequence) - edits, rows[kept], starts[kept], *shape)]
                if not len(windows):
                    continue
                kept = first[windows]
                least, _ = spans.distances(sequence, rows[kept], starts[kept], *shape)
                close = windows[least <= edits]
                if len(close):
                    places = np.concatenate([members[cuts[w] : cuts[w + 1]] for w in close])
                    for item, offset in self.members[block]:
                        self._verify(spans, item, rows[places], starts[places] - offset, best, done)
        return [(row, item, edits, self._first_word(spans, row, item, stop)) for (row, item), (edits, stop) in sorted(best.items())]

    def _verify(self, spans: _Spans, item: int, rows: np.ndarray, starts: np.ndarray, best: dict, done: set) -> None:
        """Compare the whole item with what is around each place; keep each row's best.

        Places are rounded to the limit of edits, and the stretches are longer by as much.
        """
        sequence = self.sequences[item]
        edits = most_edits(len(sequence))
        shape = (edits + 2, len(sequence) + 3 * edits + 3)
        places = np.unique(np.stack([starts - starts % (edits + 1), rows]), axis=1).T.tolist()
        places = [place for place in places if (item, *place) not in done]
        if not places:
            return
        done.update((item, *place) for place in places)
        starts, rows = np.array(places, np.int64).T
        first, group = spans.alike(rows, starts, *shape)
        least, stop = spans.distances(sequence, rows[first], starts[first], *shape)
        moved = (stop - starts[first])[group] + starts
        for k in np.flatnonzero(least[group] <= edits).tolist():
            pair, found = (int(rows[k]), item), (int(least[group[k]]), int(moved[k]))
            best[pair] = min(best.get(pair, found), found)

    def _first_word(self, spans: _Spans, row: int, item: int, stop: int) -> int:
        """Where, in its row, the shortest best match that ends before `stop` starts: the alignment read backwards."""
        sequence = self.sequences[item]
        low = int(spans.found.first[row])
        text = spans.hashes[max(low, stop - len(sequence) - most_edits(len(sequence))) : stop]
        ends = best_distance(sequence[::-1], text[None, ::-1], anchored=True)[0]
        return stop - int(ends.argmin()) - low


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The items in chunks of about the given size, cut by their hashes, one at a time on the driver, and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / chunk_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for i in range(count):
        chunk = items if count == 1 else items.where(place == i)
        yield Items(sorted((tuple(row) for row in chunk.collect()), key=str)), i + 1 == count


def contaminated(docs: DataFrame, benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, item_words and first_word of every contaminated pair."""
    schema = "doc_id long, item_id long, edits int, item_words int, first_word long"
    result = None
    for items, last in _chunks(benchmark, chunk_bytes):

        def convert(batch, items=items):
            ids = batch.column("doc_id")
            found = [
                (ids[first + row].as_py(), items.ids[item], edits, len(items.sequences[item]), word)
                for first, hashes, positions in _text_words(batch.column("text"))
                for row, item, edits, word in items.matches(hashes, positions)
            ]
            if found:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(zip(*found), types)],
                    names=["doc_id", "item_id", "edits", "item_words", "first_word"],
                )

        part = frames.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), convert, schema)
        # the pairs of a chunk are written before the next one is fetched
        part = part if last else frames.written(part, "contaminated")
        result = part if result is None else result.unionByName(part)
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents, with all their columns, that no benchmark item contaminates."""
    for items, last in _chunks(benchmark, chunk_bytes):

        def convert(batch, items=items):
            keep = np.ones(batch.num_rows, bool)
            for first, hashes, positions in _text_words(batch.column("text")):
                for row, *_ in items.matches(hashes, positions):
                    keep[first + row] = False
            yield batch.filter(pa.array(keep))

        docs = frames.map_batches(docs, convert, docs.schema)
        docs = docs if last else frames.written(docs, "clean")
    return docs
