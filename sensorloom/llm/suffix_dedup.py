"""Removal of byte strings of a given length that also start elsewhere in the corpus.

The repeated strings are found on a suffix array. Sorting the suffix at every byte would move
each byte of the corpus many times over, so the array is sparse, without losing a repeat:

- Each window of `length` bytes has one anchor, the place of the least hash among its runs of
  `ANCHOR_BYTES` bytes. Equal windows have equal anchors at equal distances, so a window can
  only repeat where its anchor's run repeats. Neighbouring windows share an anchor; such a run
  of windows is a territory.
- Territories whose anchor run occurs once are dropped. Where all territories of an anchor run
  are equal, all their windows repeat. Only the other, differing ones are compared.
- The suffixes at these anchors are range-partitioned by their leading bytes, with splitters
  that Spark samples. A bucket sorts its suffixes, and the reversed texts before the anchors, by
  multikey quicksort (eight bytes a step, ties only) and takes the common prefix of neighbours.
  Two windows are equal when they lie in one run of suffixes that agree for the part after the
  anchor and in one run of reversed texts that agree for the part before it. Splitters compare
  the whole leading run, so no two suffixes that agree that far lie across a boundary; buckets
  are worked off in pieces that end at such a change.
- Anchor runs of more than `group_rows` territories are too large for one bucket: the windows of
  their distinct territories are counted by digest, with partial sums, and joined back.

Equal territories and windows are merged before they are compared, with their number of
occurrences, so a group of copies is one row. Texts move twice: to cut out the territories
that differ, and to remove what repeats.

Defined results: null is an empty text; a text shorter than `length` keeps everything; rows
that repeat a document repeat each other's strings, so they lose them as any copies do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words

LENGTH = 200
ANCHOR_BYTES = 50
PIECE_ROWS = 20_000
GROUP_ROWS = PIECE_ROWS  # what fits in one piece of a bucket is sorted in it

_LOW = np.uint64(0xFFFFFFFF)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def territories(data: np.ndarray, offsets: np.ndarray, length: int):
    """Row, first window, windows, anchor, anchor hash and content hash of each territory of a block."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = words.prefix_sums(data)
    starts = np.arange(len(data) - ANCHOR_BYTES + 1)
    values = words.substring_hashes(sums, starts, starts + ANCHOR_BYTES)
    # the least hash, of equals the last: 32 bits of hash over 32 bits of falling position
    values &= ~_LOW
    values |= _LOW - starts.astype(np.uint64)
    least = _sliding_least(values, length - ANCHOR_BYTES + 1)
    valid = np.ones(len(least), bool)
    for end in offsets[1:]:
        valid[max(int(end) - length + 1, 0) : end] = False
    # a row shorter than a window has no valid one, and neither has what lies before it in its tail
    for begin, end in zip(offsets[:-1], offsets[1:]):
        if end - begin < length:
            valid[begin:end] = False
    windows = np.flatnonzero(valid)
    anchors = (_LOW - (least[windows] & _LOW)).astype(np.int64)
    head = np.ones(len(windows), bool)
    head[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
    heads = np.flatnonzero(head)
    first, anchor = windows[heads], anchors[heads]
    count = np.diff(np.append(heads, len(windows)))
    row = np.searchsorted(offsets, first, "right") - 1
    anchor_hash = words.substring_hashes(sums, anchor, anchor + ANCHOR_BYTES)
    content = words.substring_hashes(sums, first, first + count - 1 + length)
    content = words.combine([content, (anchor - first).astype(np.uint64), count.astype(np.uint64)])
    return row, first - offsets[row], count, anchor - first, anchor_hash, content


# A territory's first window, bytes before the anchor and number of windows share one column.
_PLACE_BITS = 10


def _pack_place(first: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first << (2 * _PLACE_BITS)) | (before << _PLACE_BITS) | count


def _first(place):
    return F.shiftright(place, 2 * _PLACE_BITS)


def _count(place):
    return place.bitwiseAND((1 << _PLACE_BITS) - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", frames.row_key(doc_id, F.col("text")).alias("row_key"))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """anchor, content, doc_id, row_key, place of every territory."""

    def convert(batch):
        keys = batch.column("row_key").to_numpy()
        for first, data, offsets in words.text_blocks(batch.column("text"), 1 << 19):
            row, start, count, before, anchor, content = territories(data, offsets, length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.astype(np.int64)),
                    pa.array(content.astype(np.int64)),
                    batch.column("doc_id").take(pa.array(first + row)),
                    pa.array(keys[first + row]),
                    pa.array(_pack_place(start, before, count)),
                ],
                names=["anchor", "content", "doc_id", "row_key", "place"],
            )

    schema = "anchor long, content long, doc_id long, row_key long, place long"
    return frames.map_batches(_keyed(docs).select("doc_id", "row_key", "text"), convert, schema)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (one width) and the common prefix of each with the one before it.

    Multikey quicksort, eight bytes a step: rows are split by the current word, and only those
    that still tie go on to the next.
    """
    count, width = rows.shape
    padded = np.zeros((count, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order = np.arange(count)
    part = np.zeros(count, np.int64)  # start of the tied part that each place belongs to
    tied = np.arange(count)
    for step in range(keys.shape[1]):
        word = keys[order[tied], step]
        turn = np.lexsort((word, part[tied]))
        order[tied] = order[tied][turn]
        word = word[turn]
        split = np.ones(len(tied), bool)
        split[1:] = (part[tied][1:] != part[tied][:-1]) | (word[1:] != word[:-1])
        heads = np.flatnonzero(split)
        sizes = np.diff(np.append(heads, len(tied)))
        part[tied] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        if not len(tied):
            break
    ordered = rows[order]
    common = np.zeros(count, np.int64)
    if count > 1 and width:
        other = ordered[1:] != ordered[:-1]
        common[1:] = np.where(other.any(1), other.argmax(1), width)
    return order, common


def repeated_windows(
    texts: list[bytes], before: np.ndarray, count: np.ndarray, times: np.ndarray, length: int
) -> list[np.ndarray]:
    """For each distinct territory, which of its windows occur more than once among all.

    Each occurs `times` times; `before` is the number of bytes before its anchor, `count` its
    number of windows, and its text is count - 1 + length bytes.
    """
    size = len(texts)
    after = np.zeros((size, length), np.uint8)
    ahead = np.zeros((size, length - ANCHOR_BYTES), np.uint8)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        right = raw[before[i] : before[i] + length]
        after[i, : len(right)] = right
        ahead[i, : before[i]] = raw[: before[i]][::-1]
    places = []
    for rows in (after, ahead):
        order, common = multikey_order(rows)
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        places.append((rank, common))
    (rank_after, common_after), (rank_ahead, common_ahead) = places
    found = np.zeros((size, int(count.max())), bool)
    least = before - count + 1
    for distance in range(int(least.min()), int(before.max()) + 1):
        own = np.flatnonzero((least <= distance) & (distance <= before))
        if not len(own):
            continue
        same_after = np.cumsum(common_after < length - distance)[rank_after[own]]
        same_ahead = np.cumsum(common_ahead < distance)[rank_ahead[own]]
        _, group = np.unique(same_after * np.int64(size + 1) + same_ahead, return_inverse=True)
        again = np.bincount(group, times[own])[group] > 1
        found[own[again], before[own[again]] - distance] = True
    return [found[i, : count[i]] for i in range(size)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


_RUNS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_VERDICT = "anchor long, content long, runs array<struct<low:int,high:int>>"


def _in_buckets(cut: DataFrame, length: int) -> DataFrame:
    """Verdicts on territories (anchor, content, times, before, count, text) from sorted buckets."""

    def settle(piece):
        unique = {(anchor, content): rest for anchor, content, *rest in piece}
        times, before, count, texts = zip(*unique.values())
        times, before, count = (np.array(x, np.int64) for x in (times, before, count))
        flags = repeated_windows(list(texts), before, count, times, length)
        rows = [(*key, _runs(own)) for key, own in zip(unique, flags) if own.any()]
        if rows:
            yield pa.RecordBatch.from_pylist(
                [
                    {"anchor": a, "content": c, "runs": [{"low": low, "high": high} for low, high in runs]}
                    for a, c, runs in rows
                ],
                schema=pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("runs", _RUNS)]),
            )

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, lead = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "content", "times", "before", "count", "text")]
            for row in zip(*columns):
                own = row[5][row[3] : row[3] + ANCHOR_BYTES]
                if own != lead and len(piece) >= PIECE_ROWS:
                    yield from settle(piece)
                    piece = []
                lead = own
                piece.append(row)
        if piece:
            yield from settle(piece)

    lead = F.expr(f"substring(text, before + 1, {ANCHOR_BYTES})")
    return cut.repartitionByRange(lead).sortWithinPartitions(lead).mapInArrow(convert, _VERDICT)


def _by_digest(cut: DataFrame, length: int) -> DataFrame:
    """Verdicts on the territories of large groups, by counting the digests of their windows."""

    def convert(batch):
        for first, data, offsets in words.text_blocks(batch.column("text")):
            rows = np.arange(len(offsets) - 1)
            count = batch.column("count").to_numpy()[first + rows]
            row = np.repeat(rows, count)
            window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[row] + window
            digest = words.substring_hashes(words.prefix_sums(data), start, start + length)
            distance = batch.column("before").to_numpy()[first + row] - window
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(first + row)) for c in ("anchor", "content", "times")),
                    pa.array(words.combine([digest, distance.astype(np.uint64)]).astype(np.int64)),
                    pa.array(window.astype(np.int32)),
                ],
                names=["anchor", "content", "times", "digest", "window"],
            )

    schema = "anchor long, content long, times long, digest long, window int"
    windows = frames.map_batches(cut.dropDuplicates(["anchor", "content"]), convert, schema)
    again = windows.groupBy("anchor", "digest").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
    found = windows.join(again, ["anchor", "digest"])

    def merge(batch):
        rows = []
        for own in batch.column("windows").to_pylist():
            flags = np.zeros(max(own) + 1, bool)
            flags[own] = True
            rows.append([{"low": low, "high": high} for low, high in _runs(flags)])
        columns = [batch.column("anchor"), batch.column("content"), pa.array(rows, _RUNS)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "runs"])

    gathered = found.groupBy("anchor", "content").agg(F.collect_list("window").alias("windows"))
    return frames.map_batches(gathered, merge, _VERDICT)


def repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, row_key and runs: first and last start of the repeated strings of each document that has any."""
    if not ANCHOR_BYTES < length < 1 << _PLACE_BITS:
        raise ValueError(f"length must lie between {ANCHOR_BYTES} and {1 << _PLACE_BITS}")
    anchored = _anchored(docs, length)
    # counts are written before they are joined back, so that a hot anchor's rows can be split in the join
    twice = anchored.select("anchor").groupBy("anchor").count().where("count > 1").select("anchor")
    twice = frames.written(twice, "repeated-anchors")
    shared = frames.written(anchored.join(twice, "anchor"), "anchors")
    kinds = shared.groupBy("anchor").agg(
        F.count("*").alias("occurrences"), (F.min("content") == F.max("content")).alias("alike")
    )
    known = frames.written(shared.join(frames.written(kinds, "kinds"), "anchor"), "known")
    whole = known.where("alike").select(
        "doc_id", "row_key", _first(F.col("place")).alias("low"), (_first(F.col("place")) + _count(F.col("place")) - 1).alias("high")
    )

    # one holder of each differing territory brings its text
    holders = (
        known.where("not alike")
        .groupBy("anchor", "content")
        .agg(
            F.count("*").alias("times"),
            F.min(F.struct("row_key", "doc_id", "place")).alias("at"),
            F.first(F.col("occurrences") > group_rows).alias("large"),
        )
        .select("anchor", "content", "times", "large", "at.doc_id", "at.row_key", "at.place")
    )
    wanted = holders.groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row")).agg(
        F.collect_list(F.struct("anchor", "content", "times", "large", "place")).alias("wanted")
    )
    keyed = _keyed(docs).select("doc_id", "row_key", "text")
    same = keyed["doc_id"].eqNullSafe(wanted["_doc"]) & (keyed["row_key"] == wanted["_row"])
    held = keyed.join(wanted, same).select("text", "wanted")
    cut = frames.written(_cut_out(held, length), "territories")
    verdicts = frames.written(
        _in_buckets(cut.where("not large"), length).unionByName(_by_digest(cut.where("large"), length)), "verdicts"
    )
    part = (
        known.where("not alike")
        .select("anchor", "content", "doc_id", "row_key", "place")
        .join(verdicts, ["anchor", "content"])
        .select("doc_id", "row_key", _first(F.col("place")).alias("at"), F.explode("runs").alias("run"))
        .select("doc_id", "row_key", (F.col("at") + F.col("run.low")).alias("low"), (F.col("at") + F.col("run.high")).alias("high"))
    )
    return (
        whole.unionByName(part)
        .distinct()
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    )


def _cut_out(held: DataFrame, length: int) -> DataFrame:
    names = ("anchor", "content", "times", "large", "place")
    low = (1 << _PLACE_BITS) - 1

    def convert(batch):
        rows = []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            raw = memoryview(text.as_buffer())
            for territory in wanted:
                anchor, content, times, large, place = (territory[n] for n in names)
                first, before, count = place >> (2 * _PLACE_BITS), (place >> _PLACE_BITS) & low, place & low
                rows.append((anchor, content, times, large, before, count, bytes(raw[first : first + count - 1 + length])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["anchor", "content", "times", "large", "before", "count", "text"],
        )

    schema = "anchor long, content long, times long, large boolean, before int, count int, text binary"
    return frames.map_batches(held, convert, schema)


def _covered(size: int, runs: list[dict] | None, length: int) -> np.ndarray:
    """Which bytes a repeated string covers."""
    change = np.zeros(size + 1, np.int32)
    for run in runs or ():
        change[run["low"]] += 1
        change[run["high"] + length] -= 1
    return np.cumsum(change[:size]) > 0


def _with_runs(docs: DataFrame, length: int, group_rows: int) -> DataFrame:
    """The documents with all their columns and the column __llm_runs, null where nothing repeats."""
    found = repeats(docs, length, group_rows).select(
        F.col("doc_id").alias("__llm_doc"), F.col("row_key").alias("__llm_row"), F.col("runs").alias("__llm_runs")
    )
    own = F.col("doc_id").cast("long")
    same = own.eqNullSafe(F.col("__llm_doc")) & (F.col("__llm_key") == F.col("__llm_row"))
    keyed = docs.withColumn("__llm_key", frames.row_key(own, F.col("text")))
    return keyed.join(found, same, "left").drop("__llm_key", "__llm_row", "__llm_doc")


def removals(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def convert(batch):
        sizes, removed, spans, digests = [], [], [], []
        for text, runs in zip(batch.column("text"), batch.column("__llm_runs").to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            sizes.append(len(raw))
            if runs:
                gone = _covered(len(raw), runs, length)
                removed.append(int(gone.sum()))
                spans.append(len(_runs(gone)))
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                removed.append(0)
                spans.append(0)
            digests.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return frames.map_batches(_with_runs(own, length, group_rows), convert, schema)


def remove(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The documents, with all their columns, without the repeated strings; n_chars follows the text.

    A character goes when all its bytes are covered. No document goes: one that was all
    repeats has an empty text.
    """
    schema = docs.schema
    place = docs.columns.index("text")

    def convert(batch):
        texts = batch.column("text").to_pylist()
        for i, runs in enumerate(batch.column("__llm_runs").to_pylist()):
            if runs:
                raw = np.frombuffer(texts[i].encode(), np.uint8)
                gone = _covered(len(raw), runs, length)
                heads = np.flatnonzero((raw & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(gone, heads)
                texts[i] = raw[~np.repeat(whole, np.diff(np.append(heads, len(raw))))].tobytes().decode()
        columns = [batch.column(name) for name in schema.names]
        columns[place] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    cleaned = frames.map_batches(_with_runs(docs, length, group_rows), convert, schema)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    size = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
    return cleaned.withColumn("n_chars", size)
