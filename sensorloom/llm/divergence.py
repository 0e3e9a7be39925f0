"""Source divergence audit: how far the sources of a language differ in their use of terms.

Terms are lower-cased (A-Z only) runs of letters and non-ASCII characters. Each language keeps
the terms of at least `least_docs` of its documents. A group (language, source) gives each kept
term a smoothed share p, in integers; two groups differ by the sum over all kept terms of
f(p, q) = floor((p - q)^2 / (p + q)), and the terms that a group uses more than its language
are listed with the same f. All arithmetic is on integers.

- Counting: a task adds up (group, term) over its own documents before anything is shuffled.
- Pairs: a multiplication of the group-by-term matrix with its transpose, one row at a time. In
  a tile (a block of terms, a block of groups and a block of peers, all of bounded size) the
  peers' postings are indexed by term; each group scatters its terms through that index into
  one dense accumulator over the peers, so no pair of postings becomes a row. The accumulator
  starts as if no term were shared: every term of one side against the other side's share of an
  absent term, and the absent ones of both; a shared term takes back what the start has for it.
- Tiles give partial sums, which are added over the blocks of terms.

Defined results: null text, lang and source are read as empty; each row is a document; a group
without terms has absent terms only; a language without kept terms has pairs of value 0 and no
terms; ties rank by the UTF-8 bytes of the item; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import frames

LEAST_DOCS = 10
SHOWN_TERMS = 10
BLOCK_TERMS = 16_384
BLOCK_SOURCES = 128
LOOKED_UP_LANGS = 100_000  # more are joined by a shuffle
HELD_ENTRIES = 400_000  # counts that a task holds before it passes them on

_SCALE = 1_000_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # every byte of a non-ASCII character is in it


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and n_docs added up over a task's documents; the row without term counts the documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def batch_of_counts():
        for (lang, source), (totals, documents) in held.items():
            terms = [None if term is None else term.decode() for term in documents]
            size = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(terms, pa.string()),
                    pa.array([totals[term] for term in documents], pa.int64()),
                    pa.array(documents.values(), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "n_docs"],
            )
        held.clear()

    for batch in batches:
        columns = [batch.column(name) for name in ("lang", "source", "text")]
        for row in range(batch.num_rows):
            lang, source, text = (column[row].as_py() for column in columns)
            totals, documents = held.setdefault((lang, source), (Counter(), Counter()))
            terms = _TERM.findall(text.encode().translate(_LOWER))
            totals.update(terms)
            documents.update(set(terms))
            documents[None] += 1
        if sum(len(documents) for _, documents in held.values()) > HELD_ENTRIES:
            yield from batch_of_counts()
    yield from batch_of_counts()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and n_docs; a null term stands for the group itself."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = rows.mapInArrow(_counts, "lang string, source string, term string, n long, n_docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * terms)), exact whatever the counts."""
    return F.call_function(
        "div",
        F.lit(_SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"),
        (total + 2 * terms).cast("decimal(20,0)"),
    ) + F.lit(1).cast("long")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Model:
    """Kept terms, groups and languages of a table of documents; each written once and read several times."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        counts = frames.written(term_counts(docs), "term-counts")
        terms = counts.where("term IS NOT NULL")
        kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
        kept = frames.written(kept.where(F.col("n_docs") >= least_docs).drop("n_docs"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        langs = frames.written(langs, "langs")
        self.langs = F.broadcast(langs) if langs.count() <= LOOKED_UP_LANGS else langs
        # terms are numbered within blocks of about BLOCK_TERMS
        block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK_TERMS))
        numbered = Window.partitionBy("lang", "term_block").orderBy("term")
        kept = kept.join(self.langs, "lang").withColumn("term_block", block).repartition("lang", "term_block")
        kept = kept.withColumn("term_no", F.row_number().over(numbered) - 1)
        self.terms = frames.written(kept, "numbered-terms")
        #: lang, source, term, n and what the language knows of the term
        self.uses = frames.written(terms.select("lang", "source", "term", "n").join(self.terms, ["lang", "term"]), "uses")
        totals = self.uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
        groups = groups.join(self.langs.select("lang", "v"), "lang", "left").fillna(0, ["total", "v"])
        #: lang, source, total (of kept terms) and v (kept terms of the language)
        self.groups = frames.written(groups, "groups")

    def raised_terms(self, shown: int = SHOWN_TERMS) -> DataFrame:
        """The terms that a group uses more than its language does, the largest f first."""
        rows = self.uses.join(self.groups.select("lang", "source", "total"), ["lang", "source"])
        rows = rows.select(
            "lang",
            "source",
            F.col("term").alias("item"),
            _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
            _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
        ).where("p > q")
        rows = rows.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
        return _ranked(rows).where(F.col("rank") <= shown)

    def pairs(self, block_sources: int = BLOCK_SOURCES) -> DataFrame:
        """Every group with every other source of its language."""
        return _ranked(
            self._tiles(block_sources)
            .groupBy("lang", "term_block", "low", "high")
            .applyInArrow(_tile, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item")
            .agg(F.sum("value").alias("value"))
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        )

    def _tiles(self, block_sources: int) -> DataFrame:
        """A row for each group and block of terms, once for each block of peers."""
        share = _share(F.col("n"), F.col("total"), F.col("v"))
        postings = (
            self.uses.join(self.groups.select("lang", "source", "total"), ["lang", "source"])
            .groupBy("lang", "source", "term_block")
            .agg(F.collect_list(F.struct("term_no", share.alias("p"))).alias("postings"))
        )
        sources = self.groups.groupBy("lang").agg(F.ceil(F.count("*") / block_sources).alias("source_blocks"))
        width = self.terms.groupBy("lang", "term_block").agg(F.count("*").alias("width"))
        absent = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(1)
        last_block = F.greatest(F.ceil(F.col("v") / BLOCK_TERMS), F.lit(1)) - 1
        rows = self.groups.join(sources, "lang").select(
            "lang",
            "source",
            absent.alias("absent"),
            F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("term_block"),
            F.pmod(F.xxhash64("source"), "source_blocks").alias("own"),
            "source_blocks",
        )
        rows = rows.join(width, ["lang", "term_block"], "left").join(postings, ["lang", "source", "term_block"], "left")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)).alias("other")
        return rows.select("*", other).select(
            "lang",
            "term_block",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "source",
            "absent",
            F.coalesce("width", F.lit(0)).alias("width"),
            F.coalesce(F.transform("postings", lambda x: x["term_no"]), F.array().cast("array<int>")).alias("numbers"),
            F.coalesce(F.transform("postings", lambda x: x["p"]), F.array().cast("array<bigint>")).alias("shares"),
        )


class _Side:
    """The groups of one block in a tile: their postings one after the other."""

    def __init__(self, rows: pa.Table):
        self.names = rows.column("source").to_pylist()
        self.absent = rows.column("absent").to_numpy()
        numbers, shares = (rows.column(name).combine_chunks() for name in ("numbers", "shares"))
        sizes = np.diff(numbers.offsets.to_numpy())
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes
        self.sizes = sizes.astype(np.int64)
        self.number = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.share = shares.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def histogram(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (group, share) and how many terms have it."""
        found, counts = np.unique(np.stack([self.owner, self.share]), axis=1, return_counts=True)
        return found[0], found[1], counts


def _accumulated(rows: _Side, peers: _Side, width: int) -> Iterator[np.ndarray]:
    """For each group its sums with all peers over one block of terms."""
    order = np.argsort(peers.number, kind="stable")  # the term-major index of the peers
    peer, share = peers.owner[order], peers.share[order]
    begin = np.searchsorted(peers.number[order], np.arange(width + 1))
    row_of, row_share, row_count = rows.histogram()
    row_cut = np.searchsorted(row_of, np.arange(len(rows.names) + 1))
    peer_of, peer_share, peer_count = peers.histogram()
    for group in range(len(rows.names)):
        absent = rows.absent[group]
        neither = _distance(absent, peers.absent)
        sums = (width - rows.sizes[group] - peers.sizes) * neither
        for k in range(row_cut[group], row_cut[group + 1]):
            sums += row_count[k] * _distance(row_share[k], peers.absent)
        np.add.at(sums, peer_of, peer_count * _distance(absent, peer_share))
        own = slice(rows.first[group], rows.ends[group])
        low, high = begin[rows.number[own]], begin[rows.number[own] + 1]
        count = high - low
        hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        p, q, at = np.repeat(rows.share[own], count), share[hit], peer[hit]
        shared = _distance(p, q) - _distance(p, peers.absent[at]) - _distance(absent, q) + neither[at]
        np.add.at(sums, at, shared)
        yield sums


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    lang, _, low, high = (value.as_py() for value in key)
    width = table.column("width")[0].as_py()
    own = table.column("own").to_numpy()
    rows = _Side(table.filter(pa.array(own == low)))
    peers = rows if low == high else _Side(table.filter(pa.array(own == high)))
    parts = []
    names, others = np.array(rows.names, object), np.array(peers.names, object)
    for group, sums in enumerate(_accumulated(rows, peers, width)):
        different = others != names[group] if low == high else np.ones(len(others), bool)
        mine, theirs = np.full(different.sum(), names[group], object), others[different]
        parts.append((mine, theirs, sums[different]))
        if low != high:
            parts.append((theirs, mine, sums[different]))
    source, item, value = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
    return pa.table(
        {
            "lang": pa.array([lang] * len(source), pa.string()),
            "source": pa.array(source, pa.string()),
            "item": pa.array(item, pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, shown: int = SHOWN_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    model = Model(docs, least_docs)
    return model.pairs(block_sources).unionByName(model.raised_terms(shown))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
occurring AS (
    SELECT lang, source, doc, term, count(*) AS n
    FROM (SELECT lang, source, doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM occurring GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
uses AS (SELECT lang, source, term, sum(n) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counted AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, v, lang_total,
        sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
    FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN uses USING (lang, source, term)),
shares AS (
    SELECT lang, source, term, n, 1 + CAST(1000000000 * (n + 2) // (total + 2 * v) AS BIGINT) AS p,
        1 + CAST(1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q
    FROM counted),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
raised AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM raised
QUALIFY rank <= 10
"""
