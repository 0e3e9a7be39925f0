"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Only which documents are connected is asked for, so copies are never expanded into pairs:

- Equal sets are one node, known by a 64-bit digest of the set.
- Two sets that link share one of the first n - ceil(t * n) + 1 members of each in any common
  order. The order puts n-grams of rare words first and frequent n-grams last (both learnt from
  a bounded sample of documents; it only decides how large the blocks get, never what is found).
  Of the first member that two sets share, no more than the rest of either follows, so the places
  and sizes in a member's rows tell which sets may link there: those form a block. Blocks with
  the same smallest node form a group. Members are shuffled once for it, in 16 bytes each.
- Within a group, tokens are hashed into groups and their counts are the points of an R-tree:
  the sum of coordinate minima bounds the overlap of a point with all points below a tree
  node. Nodes that no other one survives for are left out before any text is moved; the
  others are verified on the sets, within their group. Nodes that are already connected are not
  compared again, so a group of copies costs about one comparison a member.
- A group beyond `cell_nodes` is dealt into cells, each of which has the group's smallest node
  too. Groups that are not in one piece after that have their cells compared in pairs, leaving
  out nodes that are connected already.

Defined results: words are runs of anything but space and \\x09-\\x0D, ASCII lower-cased; a text
with fewer words than an n-gram has its whole sequence as its one member; null, empty and
blank texts have no member and link with nothing. Repeated rows are equal documents. A null
doc_id is never the name of a component unless all of it has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words
from sensorloom.llm.components import components

WIDTH = 4
PERCENT = 85
POINT_DIMENSIONS = 1_024  # enough for the bound to tell sets of tens of thousands of members apart
LEAF = 16
UNPACKED_ROWS = 256
CELL_NODES = 1_000
ORDER_DOCUMENTS = 5_000
ORDER_TIMES = 5
ORDER_MEMBERS = 100_000
ORDER_WORDS = 100_000

_FREQUENT = np.uint64(1 << 63)
# a key: 40 bits of the member, then its set's size and what of the set is left from there on
_CODE_BITS = 12
_EXTENT = np.uint64(2 * _CODE_BITS)
_CODE = np.uint64((1 << _CODE_BITS) - 1)


def _members(texts: pa.Array, width: int, order_of: Order | None = None):
    """Blocks of (first row, rows, members, first member of each row, ranks); members 63-bit and distinct.

    Ranks are the members' places in the order, and None without one.
    """
    for first, data, offsets in words.text_blocks(texts):
        data = words.lower_ascii(data)
        found = words.find_words(data, offsets)
        hashes = words.word_hashes(data, found)
        members, rows = words.shingles(hashes, found, width)
        members >>= np.uint64(1)
        order = np.lexsort((members, rows))
        members, rows = members[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (members[1:] != members[:-1])
        rows, members = rows[new], members[new]
        ranks = None
        if order_of is not None:
            ranks = order_of.ranks(members, words.shingle_sums(order_of.weights(hashes), found, width)[order][new])
        yield first, rows, members, np.searchsorted(rows, np.arange(len(offsets))), ranks


def _digests(members: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A digest of each set that does not depend on order."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(members + np.uint64(1)), dtype=np.uint64)])
    sizes = np.diff(cuts).astype(np.uint64)
    return words.mix(total[cuts[1:]] - total[cuts[:-1]] + sizes * np.uint64(0xD6E8FEB86659FD93))


def _places(wanted: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted wanted ones, and the places there of those."""
    if not len(wanted):
        return np.zeros(len(values), bool), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    known = wanted[place] == values
    return known, place[known]


class Order:
    """An order of members: n-grams of rare words first, those that documents share often last."""

    def __init__(self, frequent: np.ndarray, common: np.ndarray, counts: np.ndarray):
        """frequent: members, the least frequent first; common and counts: hashes of words and how many there are."""
        self.by_value = np.argsort(frequent).astype(np.uint64)
        self.frequent = np.sort(frequent)
        by_hash = np.argsort(common)
        self.common = common[by_hash]
        # sixteenths of a power of two, so that sums stand for products
        self.logs = np.rint(16 * np.log2(1.0 + counts[by_hash])).astype(np.uint64)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        known, place = _places(self.common, hashes)
        weights = np.zeros(len(hashes), np.uint64)
        weights[known] = self.logs[place]
        return weights

    def ranks(self, members: np.ndarray, sums: np.ndarray) -> np.ndarray:
        ranks = np.minimum(sums, np.uint64(2047)) << np.uint64(52) | members >> np.uint64(11)
        known, place = _places(self.frequent, members)
        ranks[known] = _FREQUENT + self.by_value[place]
        return ranks


def learnt_order(docs: DataFrame, width: int) -> Order:
    """The order by a sample of documents: at most ORDER_MEMBERS members and ORDER_WORDS words of it."""
    share = min(1.0, ORDER_DOCUMENTS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) < F.lit(int(share * (1 << 62))))

    def convert(batch):
        for _, data, offsets in words.text_blocks(batch.column("text")):
            data = words.lower_ascii(data)
            hashes = words.word_hashes(data, words.find_words(data, offsets))
            yield _counted(True, *np.unique(hashes, return_counts=True))
        for _, _, members, _, _ in _members(batch.column("text"), width):
            yield _counted(False, *np.unique(members, return_counts=True))

    parts = frames.map_batches(sample.select("text"), convert, "word boolean, value long, times long")
    counted = parts.groupBy("word", "value").agg(F.sum("times").alias("times"))
    least = F.when(F.col("word"), F.lit(2)).otherwise(F.lit(ORDER_TIMES))
    counted = frames.written(counted.where(F.col("times") >= least), "order")

    def most(kind: Column, limit: int) -> pa.Table:
        return counted.where(kind).orderBy(F.desc("times"), "value").limit(limit).select("value", "times").toArrow()

    frequent, common = most(~F.col("word"), ORDER_MEMBERS), most(F.col("word"), ORDER_WORDS)
    values = [table.column("value").to_numpy().astype(np.uint64) for table in (frequent, common)]
    return Order(values[0][::-1], values[1], common.column("times").to_numpy())


def _counted(word: bool, values: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(values), word)), pa.array(values.astype(np.int64)), pa.array(times.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "value", "times"])


def _coded(values: np.ndarray) -> np.ndarray:
    """Numbers in 12 bits that ascend with them: exact below 256, then the first eight digits of two."""
    shift = np.maximum(np.frexp(values.astype(np.float64))[1] - 8, 0)
    return (shift * 128 + (values >> shift)).astype(np.uint64)


def _least_of(codes: np.ndarray) -> np.ndarray:
    """The least number of each code."""
    codes = codes.astype(np.int64)
    shift = np.maximum(codes // 128 - 1, 0)
    return (codes - shift * 128) << shift


def _keys(members: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Members to block by, with their sets' sizes and how many members are left from each on."""
    extent = _coded(sizes) << np.uint64(_CODE_BITS) | _coded(left)
    return (members >> (_EXTENT - np.uint64(1))) << _EXTENT | extent


def sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, keys: bool = True) -> DataFrame:
    """doc_id, row_key, node (digest of the set), n_shingles; keys, the members to block by; point, the counts."""
    order_of = learnt_order(docs, width) if keys else None

    def convert(batch):
        for first, rows, members, cuts, ranks in _members(batch.column("text"), width, order_of):
            count = len(cuts) - 1
            sizes = np.diff(cuts)
            columns = [
                batch.column("doc_id").slice(first, count),
                batch.column("row_key").slice(first, count),
                pa.array(_digests(members, cuts).astype(np.int64)),
                pa.array(sizes.astype(np.int64)),
            ]
            if keys:
                order = np.lexsort((ranks, rows))
                turn = np.arange(len(rows)) - cuts[rows]
                chosen = turn < (sizes - (percent * sizes + 99) // 100 + 1)[rows]
                own = sizes[rows[chosen]]
                kept = _keys(members[order][chosen], own, own - turn[chosen]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows[chosen], minlength=count))])
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(kept)))
                columns.append(pa.array(_packed_points(members, rows, cuts), pa.binary()))
            names = ["doc_id", "row_key", "node", "n_shingles", "keys", "point"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    schema = "doc_id long, row_key long, node long, n_shingles long" + (", keys array<long>, point binary" if keys else "")
    own = docs.select(F.col("doc_id").cast("long"), "text", frames.row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    return frames.map_batches(own, convert, schema)


class CountTree:
    """An R-tree of two levels over count vectors: each tree node keeps its coordinates' maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.leaves = self._tops(points)
        self.stems = self._tops(self.leaves)

    @staticmethod
    def _tops(points: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(points, np.arange(0, len(points), LEAF))

    def search(self, point: np.ndarray, low: int, high: int, needed: np.ndarray) -> np.ndarray:
        """Places from low to high whose overlap with the point may reach what they need.

        Points are in ascending order of size, and so are the needs.
        """
        stems = np.arange(low // LEAF**2, (high - 1) // LEAF**2 + 1)
        least = needed[np.maximum(stems * LEAF**2, low) - low]
        stems = stems[np.minimum(self.stems[stems], point).sum(1) >= least]
        leaves = (stems[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[(leaves >= low // LEAF) & (leaves <= (high - 1) // LEAF)]
        least = needed[np.maximum(leaves * LEAF, low) - low]
        leaves = leaves[np.minimum(self.leaves[leaves], point).sum(1) >= least]
        places = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        places = places[(places >= low) & (places < high)]
        return places[np.minimum(self.points[places], point).sum(1) >= needed[places - low]]


def _counts(members: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """How many members of each row fall into each group of hashes: the row's point."""
    group = (members % np.uint64(POINT_DIMENSIONS)).astype(np.int64)
    counts = np.bincount(rows * POINT_DIMENSIONS + group, minlength=count * POINT_DIMENSIONS)
    return counts.reshape(count, POINT_DIMENSIONS).astype(np.int32)


def _packed_points(members: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The points of a block's rows, packed; few rows at a time, as a block may have many short ones."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
    packed = []
    for low in range(0, len(cuts) - 1, UNPACKED_ROWS):
        high = min(low + UNPACKED_ROWS, len(cuts) - 1)
        own = slice(cuts[low], cuts[high])
        packed += [pack.compress(_point_bytes(p)) for p in _counts(members[own], rows[own] - low, high - low)]
    return packed


def _points(members: list[np.ndarray]) -> np.ndarray:
    rows = np.repeat(np.arange(len(members)), [len(m) for m in members])
    return _counts(np.concatenate(members), rows, len(members))


def _point_bytes(point: np.ndarray) -> bytes:
    """Counts in one byte each where they fit, else in four."""
    return point.astype("u1" if point.max() < 256 else "<u4").tobytes()


def _point_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == POINT_DIMENSIONS else "<u4").astype(np.int32)


def _needed(size, others: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes: 100 * overlap >= percent * (both - overlap)."""
    return -(-percent * (size + others) // (100 + percent))


def may_link(points: np.ndarray, percent: int) -> np.ndarray:
    """Which of a group's points have another one that the bound does not rule out."""
    sizes = points.sum(1)
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    hit = np.zeros(len(points), bool)
    tree = CountTree(points, sizes)
    for i in range(1, len(points)):
        low = int(np.searchsorted(sizes[:i], -(-percent * sizes[i] // 100)))
        if low < i:
            near = tree.search(points[i], low, i, _needed(sizes[i], sizes[low:i], percent))
            hit[near] = True
            hit[i] |= len(near) > 0
    found = np.zeros(len(points), bool)
    found[order] = hit
    return found


def link_within(members: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all sets of a cell which links connect.

    labels tells which sets are connected already; with sides, only pairs of different sides
    are compared. Members are sorted and distinct.
    """
    sizes = np.array([len(m) for m in members])
    order = np.argsort(sizes, kind="stable")
    members, sizes, labels = [members[i] for i in order], sizes[order], labels[order].copy()
    sides = None if sides is None else sides[order]
    points = _points(members)
    tree = CountTree(points, sizes)
    found = []
    for i in range(1, len(members)):
        if (labels[: i + 1] == labels[i]).all():
            continue
        low = int(np.searchsorted(sizes[:i], -(-percent * sizes[i] // 100)))
        if low == i:
            continue
        near = tree.search(points[i], low, i, _needed(sizes[i], sizes[low:i], percent))
        near = near[labels[near] != labels[i]]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        while len(near):
            k = near[-1]
            near = near[:-1]
            overlap = len(np.intersect1d(members[i], members[k], assume_unique=True))
            if 100 * overlap >= percent * (sizes[i] + sizes[k] - overlap):
                found.append((int(order[i]), int(order[k])))
                labels[labels == labels[k]] = labels[i]
                near = near[labels[near] != labels[i]]
    return found


def _link_cells(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within each cell of rows (cell..., node, side, label, packed)."""

    def finish(cell):
        nodes, sides, labels, members = zip(*cell)
        sides = np.array(sides)
        both = sides if (sides >= 0).all() else None
        marks = np.unique(np.array(labels), return_inverse=True)[1]
        return [(nodes[i], nodes[k]) for i, k in link_within(list(members), marks, both, percent)]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, cell = None, []
        # few rows at a time: texts are many times as large unpacked
        for batch in (batch.slice(i, UNPACKED_ROWS) for batch in batches for i in range(0, batch.num_rows, UNPACKED_ROWS)):
            links = []
            texts = pa.array([unpack.decompress(x).decode() for x in batch.column("packed").to_pylist()], pa.string())
            own = [m for _, _, members, cuts, _ in _members(texts, width) for m in np.split(members, cuts[1:-1])]
            columns = [batch.column(c).to_pylist() for c in ("lead", "first", "second", "node", "side", "label")]
            for lead, first, second, node, side, label, members in zip(*columns, own):
                if (lead, first, second) != key:
                    if len(cell) > 1:
                        links += finish(cell)
                    key, cell = (lead, first, second), []
                cell.append((node, side, label, members))
            if links:
                yield _pairs(links)
        if len(cell) > 1:
            links = finish(cell)
            if links:
                yield _pairs(links)

    keys = ["lead", "first", "second"]
    dealt = rows.select(*keys, "node", "side", "label", "packed").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(convert, "a long, b long")


def _pairs(pairs: list[tuple[int, int]], names: Sequence[str] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*pairs)], names=list(names))


def may_share(keys: np.ndarray, nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """lead and node: of sorted rows of whole runs of a member, the nodes that may link there, in blocks.

    A set of n members of which r are left may link with one of m members only if
    100 * r >= percent * (n + m - r) holds for the r of both. A block has the sizes that reach each
    other, maybe over others between; its lead is its smallest node.
    """
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    heads = np.ones(len(keys) + 1, bool)
    heads[1:-1] = keys[1:] >> _EXTENT != keys[:-1] >> _EXTENT
    several = ~(heads[:-1] & heads[1:])
    keys, nodes, heads = keys[several], nodes[several], heads[:-1][several]
    if not len(keys):
        return nodes, nodes
    sizes = _least_of(keys >> np.uint64(_CODE_BITS) & _CODE)
    left = _least_of((keys & _CODE) + np.uint64(1)) - 1
    reach = left * (100 + percent) // percent - sizes  # the greatest size that it may link with

    def greatest(values, marks):
        """The greatest value so far of each run of marks."""
        lift = np.cumsum(marks) * (int(values.max()) + 1)
        return np.maximum.accumulate(values + lift) - lift

    before = np.concatenate([[0], greatest(reach, heads)[:-1]])
    heads |= sizes > before
    starts = np.flatnonzero(heads)
    piece = np.cumsum(heads) - 1
    ends = np.append(heads[1:], True)
    after = np.append(greatest(reach[::-1], ends[::-1])[::-1][1:], 0)
    follows = np.append(sizes[1:], 0)
    kept = ~heads & (sizes[starts][piece] <= reach) | ~ends & (follows <= reach) & (after >= sizes)
    kept &= (np.bincount(piece[kept], minlength=len(starts)) > 1)[piece]
    nodes, piece = nodes[kept], piece[kept]
    if not len(nodes):
        return nodes, nodes
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    return np.repeat(np.minimum.reduceat(nodes, starts), np.diff(np.append(starts, len(nodes)))), nodes


def groups(found: DataFrame, percent: int) -> DataFrame:
    """lead and node: each node with the smallest node of each block it is in, once."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            leads, nodes = may_share(*(np.concatenate(column) for column in zip(*parts)), percent)
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(leads), pa.array(nodes)], names=["lead", "node"])

        parts = []  # rows up to here; the last member's may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy().view(np.uint64)
            nodes = batch.column("node").to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[new], nodes[new]
            other = np.flatnonzero(keys >> _EXTENT != keys[-1] >> _EXTENT)
            cut = other[-1] + 1 if len(other) else 0
            if cut or parts and parts[-1][0][-1] >> _EXTENT != keys[0] >> _EXTENT:
                parts.append((keys[:cut], nodes[:cut]))
                yield from blocks()
                parts = []
            parts.append((keys[cut:], nodes[cut:]))
        if parts:
            yield from blocks()

    keyed = frames.small_batches(found.where("n_shingles > 0").select(F.explode("keys").alias("key"), "node"))
    dealt = keyed.repartition(F.shiftrightunsigned("key", int(_EXTENT))).sortWithinPartitions("key", "node")
    return frames.written(dealt.mapInArrow(convert, "lead long, node long").distinct(), "groups")


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (lead, node, point) of groups, without nodes that can link with none of their group."""

    def finish(lead, group):
        points = np.stack([_point_of(raw) for _, raw in group])
        return [(lead, group[i][0]) for i in np.flatnonzero(may_link(points, percent))]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        lead, group = None, []
        for batch in batches:
            kept = []
            for own, node, point in zip(*(batch.column(c).to_pylist() for c in ("lead", "node", "point"))):
                if own != lead:
                    kept += finish(lead, group) if len(group) > 1 else []
                    lead, group = own, []
                group.append((node, unpack.decompress(point)))
            if kept:
                yield _pairs(kept, ["lead", "node"])
        kept = finish(lead, group) if len(group) > 1 else []
        if kept:
            yield _pairs(kept, ["lead", "node"])

    dealt = rows.select("lead", "node", "point").repartition("lead").sortWithinPartitions("lead")
    return dealt.mapInArrow(convert, "lead long, node long")


def _pack(batch):
    pack = zstandard.ZstdCompressor(level=3)
    packed = [pack.compress((text or "").encode()) for text in batch.column("text").to_pylist()]
    columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(packed, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "packed"])


def links(docs: DataFrame, found: DataFrame, width: int, percent: int, cell_nodes: int) -> DataFrame:
    """Links (a, b) between nodes that connect all that the threshold connects."""
    everything = groups(found, percent)
    sizes = everything.groupBy("lead").count()
    cells = F.ceil(F.col("count") / cell_nodes).cast("long")
    counted = frames.written(everything.join(sizes.withColumn("cells", cells), "lead"), "counted")
    small = counted.where("cells = 1")
    points = frames.marked(found.where("n_shingles > 0").select("node", "point"), F.col("node"), small.select("node"), "held")
    points = points.where("held").groupBy("node").agg(F.min("point").alias("point"))
    possible = _possible(small.join(points, "node"), percent).withColumn("cells", F.lit(1).cast("long"))
    grouped = possible.unionByName(counted.where("cells > 1").select("lead", "node", "cells"))
    grouped = frames.written(grouped, "possible")
    wanted = grouped.select("node").distinct()
    holders = (
        found.select("doc_id", "row_key", "node")
        .join(wanted, "node")
        .groupBy("node")
        .agg(F.min(F.struct("row_key", "doc_id")).alias("holder"))
        .select("node", "holder.row_key", "holder.doc_id")
    )
    # one text for each node, carried packed; rows that repeat an id and text bring it once
    texts = docs.select(F.col("doc_id").cast("long"), "text", frames.row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    holders = frames.written(holders, "holders")
    texts = frames.marked(texts, F.col("row_key"), holders.select("row_key"), "held").where("held").drop("held")
    texts = frames.map_batches(texts, _pack, "doc_id long, row_key long, packed binary")
    same = texts["doc_id"].eqNullSafe(holders["doc_id"]) & (texts["row_key"] == holders["row_key"])
    packed = frames.written(texts.join(holders, same).select("node", "packed"), "texts").dropDuplicates(["node"])

    dealt = grouped.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    # the group's smallest node goes to each of its cells
    every = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    placed = dealt.withColumn("cell", F.explode(F.coalesce(every, F.array("cell"))))
    rows = placed.join(packed, "node").select(
        "lead", F.col("cell").alias("first"), F.col("cell").alias("second"), "node",
        F.lit(-1).alias("side"), F.col("node").alias("label"), "packed",
    )
    linked = frames.written(_link_cells(rows, width, percent), "cell-links")

    large = frames.written(dealt.where("cells > 1").select("lead", "cells", "cell", "node"), "large-groups")
    if large.isEmpty():
        return linked
    roots = components(linked)
    labelled = large.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    pieces = labelled.groupBy("lead").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    apart = labelled.join(pieces.select("lead"), "lead")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    paired = apart.withColumn("other", others).where("other <> cell").select(
        "lead", F.least("cell", "other").alias("first"), F.greatest("cell", "other").alias("second"),
        "node", (F.col("cell") > F.col("other")).cast("int").alias("side"), "label",
    )
    across = _link_cells(paired.join(packed, "node"), width, percent)
    return linked.unionByName(frames.written(across, "across-links"))


def _placed(docs: DataFrame, width: int, percent: int, cell_nodes: int) -> DataFrame:
    """doc_id, row_key, n_shingles and place, one value for each component, of every row."""
    found = frames.written(sets(docs, width, percent), "sets")
    roots = components(links(docs, found, width, percent, cell_nodes))
    own = found.select("doc_id", "row_key", "node", "n_shingles").join(roots, "node", "left")
    return own.withColumn("place", F.coalesce("root", "node"))


def connect(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cell_nodes: int = CELL_NODES) -> DataFrame:
    """doc_id, row_key, n_shingles and component_id of every row of documents."""
    own = _placed(docs, width, percent, cell_nodes)
    least = own.where("n_shingles > 0").groupBy("place").agg(F.min("doc_id").alias("component_id"))
    joined = own.where("n_shingles > 0").join(least, "place")
    bare = own.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "row_key", "n_shingles", "component_id")
    return joined.select(*columns).unionByName(bare.select(*columns))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, one of each component: the one of the smallest doc_id.

    Documents without words and rows without a doc_id all stay. Of rows that repeat the
    smallest id of a component, one stays.
    """
    placed = _placed(docs, width, percent, CELL_NODES).where("doc_id is not null and n_shingles > 0")
    row = F.struct("doc_id", "row_key")
    several = placed.groupBy("place").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = frames.written(several.select("place", "least"), "several")
    decided = placed.join(several, "place").select(
        F.col("row_key").alias("__llm_row"), F.col("doc_id").alias("__llm_doc"), (row == F.col("least")).alias("__llm_least")
    )
    decided = frames.written(decided.distinct(), "decided")
    spoken = F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    grouped = F.col("doc_id").isNotNull() & spoken
    key = F.when(grouped, frames.row_key(F.col("doc_id").cast("long"), F.col("text")))
    keyed = frames.marked(docs.withColumn("__llm_key", key), F.col("__llm_key"), decided.select("__llm_row"), "__llm_held")
    # only rows that may be one of several are shuffled with their texts
    held = keyed.where("__llm_held")
    same = (held["doc_id"] == decided["__llm_doc"]) & (held["__llm_key"] == decided["__llm_row"])
    held = held.join(decided, same, "left").where(F.coalesce("__llm_least", F.lit(True))).dropDuplicates(["doc_id", "__llm_key"])
    return keyed.where(~F.col("__llm_held")).select(*docs.columns).unionByName(held.select(*docs.columns))
