"""Line dedup: lines that many documents share stay in one document only.

The hashes of lines live in sorted runs, as the levels of a log-structured merge tree: a run is
a table bucketed and sorted by the hash, with the documents counted and the largest id for each
line. Documents come in batches of descending doc_id. Each batch counts its own lines,
merge-anti-joins them with the lines that the runs already settle (seen in enough documents,
the largest of which came before), and adds the rest as its own run; when a level is full its
runs are compacted into one of the next level. In the end one run tells, for every line in
enough documents, which document keeps it, and the lines of all the others are cut out.

- Counting is by partial sums, and a run has one row for each line, so no frequent line is a
  large group. Buckets are as many as shuffle partitions, so a batch is shuffled once and the
  runs never again.
- Where lines meet the verdict on them, lines in more than a small share of all entries (found
  by a sketch of bounded size, at most HEAVY_LINES of them) are looked up by broadcast and the
  others by a sort-merge join. The sketch only chooses the way, both ways are exact.
- Texts are read twice; only those with lines to cut are shuffled.

A line's key is its 128-bit digest after white space `[\\x20\\x09-\\x0D]` is stripped at both ends
and A-Z lower-cased. Keys shorter than `least_chars` code points are never dropped.

Defined results: a null or empty text is one empty line; each row is a document, so a row that
repeats an id counts again, and of rows that share the largest id all keep the line; a null id
is smaller than any other; a line repeated in a document counts once and goes or stays with all
its places; other columns are kept by `drop_lines` and not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import frames

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
FANOUT = 2
HEAVY_LINES = 1_000
TRACKED_LINES = 20_000  # of the sketch that finds them

KEY = ["head", "tail"]
_SPACE = " \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def line_places(text: str, least_chars: int) -> dict[bytes, list[int]]:
    """The places of each key that is long enough."""
    places: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split("\n")):
        line = line.strip(_SPACE)
        if len(line) >= least_chars:
            key = hashlib.blake2b(line.encode().translate(_LOWER), digest_size=16).digest()
            places.setdefault(key, []).append(at)
    return places


def line_entries(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, row_key, head, tail and places: one row for each document and line key in it."""
    schema = "doc_id long, row_key long, head long, tail long, places array<int>"

    def convert(batch):
        texts = batch.column("text")
        owners, keys, places = [], [], []
        for row in range(batch.num_rows):
            found = line_places(texts[row].as_py() or "", least_chars)
            owners += [row] * len(found)
            keys += found.keys()
            places += found.values()
        if owners:
            halves = [[int.from_bytes(key[k : k + 8], "little", signed=True) for key in keys] for k in (0, 8)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owners)),
                    batch.column("row_key").take(pa.array(owners)),
                    *(pa.array(half, pa.int64()) for half in halves),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                names=["doc_id", "row_key", *KEY, "places"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", _row_key().alias("row_key"))
    return frames.map_batches(rows, convert, schema)


class LineRuns:
    """Levels of sorted runs of (head, tail, n_docs, keeper)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]
        self._folder = frames.shared_folder(spark, "line-runs")
        self._tables: list[str] = []

    @staticmethod
    def counted(entries: DataFrame) -> DataFrame:
        """The lines of a batch: in how many documents, and the largest of them."""
        return entries.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def runs(self) -> list[DataFrame]:
        """The runs, newest first."""
        return [self.spark.table(name) for level in self.levels for name in reversed(level)]

    def unsettled(self, counts: DataFrame, least_docs: int) -> DataFrame:
        """The lines that no run has in so many documents already: a merge anti-join with each run."""
        for run in self.runs():
            counts = counts.join(run.where(F.col("n_docs") >= least_docs).select(*KEY), KEY, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """A new run of the lowest level; levels that are full are compacted."""
        self.levels[0].append(self._stored(counts))
        for level, names in enumerate(self.levels):
            if len(names) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compacted(names))
            self.levels[level] = []

    def merged(self) -> DataFrame:
        """All runs as one."""
        return self.spark.table(self._compacted([name for level in self.levels for name in level]))

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables, self.levels = [], [[]]

    def _compacted(self, names: list[str]) -> str:
        """One run of several, two at a time: a full merge join of tables that are bucketed alike."""
        first, *others = names
        for other in others:
            rows = self.spark.table(first).join(self.spark.table(other).toDF(*KEY, "n", "k"), KEY, "full")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            first = self._stored(rows.select(*KEY, n_docs.alias("n_docs"), F.greatest("keeper", "k").alias("keeper")))
        return first

    def _stored(self, counts: DataFrame) -> str:
        # as many buckets as the shuffle that made the rows has partitions: one file for each
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"line_run_{uuid.uuid4().hex}"
        (
            counts.write.bucketBy(buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self._folder}/{name}")
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        self._tables.append(name)
        return name


def _row_key() -> Column:
    return frames.row_key(F.col("doc_id"), F.col("text"))


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of the batch by doc_id: the largest ids are in batch 0, null in the last."""
    shares = [k / batches for k in range(1, batches)] or [0.0]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1_000)).first()[0] or []
    bounds = sorted(set(found[: batches - 1]))
    number = F.lit(0)
    for bound in bounds:
        number = number + (F.col("doc_id") < bound).cast("int")
    return F.coalesce(number, F.lit(len(bounds)))


def _heavy(entries: DataFrame) -> list[int]:
    """Heads of the lines in the largest shares of all entries."""
    top = entries.agg(F.expr(f"approx_top_k(head, {HEAVY_LINES}, {TRACKED_LINES})").alias("top")).first().top or []
    return [item.item for item in top if item["count"] > 1]


def cuts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, row_key and places of the lines that a document loses; documents without any are absent."""
    spark = docs.sparkSession
    folder = frames.shared_folder(spark, "line-entries")
    entries = line_entries(docs, least_chars).withColumn("batch", _batch_of(docs, batches))
    entries.write.option("compression", "zstd").partitionBy("batch").parquet(folder)
    entries = spark.read.schema(entries.schema).parquet(folder)
    runs = LineRuns(spark)
    for number in range(batches):
        own = runs.counted(entries.where(F.col("batch") == number))
        runs.add(runs.unsettled(own, least_docs))
    common = frames.written(runs.merged().where(F.col("n_docs") >= least_docs).select(*KEY, "keeper"), "common-lines")
    runs.forget()
    heavy = spark.createDataFrame([(head,) for head in _heavy(entries)], "head long")
    both = [
        entries.join(F.broadcast(common.join(F.broadcast(heavy), "head", "left_semi")), KEY),
        entries.join(F.broadcast(heavy), "head", "left_anti").join(common.hint("merge"), KEY),
    ]
    lost = both[0].unionByName(both[1]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("places")).alias("places"))


def _without_lines(rows: DataFrame) -> DataFrame:
    """The rows with the lines at `__places` cut out of their texts."""

    def convert(batch):
        texts, places = batch.column("text"), batch.column("__places")
        kept = []
        for row in range(batch.num_rows):
            lost = set(places[row].as_py() or ())
            kept.append("\n".join(x for at, x in enumerate((texts[row].as_py() or "").split("\n")) if at not in lost))
        names = batch.schema.names
        columns = [pa.array(kept, texts.type) if name == "text" else batch.column(name) for name in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return frames.map_batches(rows, convert, rows.schema)


def _marked_rows(docs: DataFrame, lost: DataFrame, columns: list) -> DataFrame:
    """The given columns with the places to cut; only rows that may have any are shuffled."""
    rows = docs.select(*columns, _row_key().alias("__row_key"))
    rows = frames.marked(rows, F.col("__row_key"), lost.select("row_key"), "__may_lose")
    wanted = lost.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("places").alias("__places"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key"))
    names = [c for c in rows.columns if c not in ("__row_key", "__may_lose")]
    # merged at any size, so that texts take the same way however few lines go
    near = rows.where("__may_lose").join(wanted.hint("merge"), same, "left").select(*names, "__places")
    return near.unionByName(rows.where("NOT __may_lose").select(*names, F.lit(None).cast("array<int>").alias("__places")))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and text (the lines that stay) of every document."""
    lost = frames.written(cuts(docs, least_chars, least_docs, batches), "line-cuts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _marked_rows(docs, lost, [F.col("doc_id").cast("long"), "text"]).select(
        "doc_id",
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("text"),
        "__places",
    )
    return _cut(rows)


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents, with all their columns, without the lines that others keep; untouched texts stay as they are."""
    lost = frames.written(cuts(docs, least_chars, least_docs, batches), "line-cuts")
    return _cut(_marked_rows(docs, lost, [F.col(f"`{c}`") for c in docs.columns]))


def _cut(rows: DataFrame) -> DataFrame:
    untouched = F.col("__places").isNull()
    return _without_lines(rows.where(~untouched)).unionByName(rows.where(untouched)).drop("__places")


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of what `dedup` returned."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
    count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""
