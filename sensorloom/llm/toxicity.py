"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the distinct words of a text is trained in numpy from confirmed toxic
documents and from unlabelled text, taken without regard to labels. With the class prior p, the
risk of calling unlabelled text toxic is corrected by what the toxic ones in it contribute:

    risk = p * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - p * E_toxic[loss(-)])

Where the corrected part falls below zero, its gradient is followed upwards, which keeps the
classifier from fitting the unlabelled toxic documents as clean. The prior is the share of
toxic documents among labelled ones. Words are runs of letters, digits and non-ASCII
characters, ASCII lower-cased; only words of several sampled documents, and of
clearly different shares among toxic and unlabelled ones, get a weight.

At most `fit_toxic` toxic and `fit_unlabelled` other documents, those with the smallest hashes
of their ids in the learning fold, are used to fit; all are scored over their whole texts.

Defined results: an empty or null text has the score of no words; a row that several labels
mark counts as toxic if one does; without a toxic label nothing is learnt and all scores are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words

FIT_TOXIC = 4_000
FIT_UNLABELLED = 12_000
LEAST_DOCUMENTS = 4
SIGNIFICANT = 3.5
EPOCHS = 120
RATE = 0.05
DECAY = 2e-4
THRESHOLD = 0.3

_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = [not chr(b).isalnum() for b in range(128)]


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each distinct word of each row, ascending by row."""
    data = words.lower_ascii(data)
    found = words.find_words(data, offsets, _BETWEEN)
    hashes = words.word_hashes(data, found)
    order = np.lexsort((hashes, found.rows))
    hashes, rows = hashes[order], found.rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], rows[new]


@dataclass
class Model:
    vocabulary: np.ndarray  # ascending hashes
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data = words.lower_ascii(data)
        found = words.find_words(data, offsets, _BETWEEN)
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.vocabulary):
            hashes = words.word_hashes(data, found)
            place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[place] == hashes
            pairs = np.unique(found.rows[known].astype(np.int64) * len(self.vocabulary) + place[known])
            rows, place = np.divmod(pairs, len(self.vocabulary))
            np.add.at(total, rows, self.weights[place])
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-total))


class _Rows:
    """Documents as runs of word numbers, one after the other."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.rows, self.size = rows, size

    def scores(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        parts = [self.rows[i] for i in chosen]
        sizes = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), sizes)
        return np.bincount(owner, weights[flat], len(parts)) + bias, flat, owner

    def slope(self, flat: np.ndarray, owner: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(flat, by_row[owner], self.size)


def _telling_words(toxic: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Words whose share among toxic documents lies SIGNIFICANT standard errors off their share elsewhere."""
    everything, group = np.unique(np.concatenate([*toxic, *unlabelled]), return_inverse=True)
    split = sum(map(len, toxic))
    in_toxic = np.bincount(group[:split], minlength=len(everything))
    in_others = np.bincount(group[split:], minlength=len(everything))
    return everything[_telling(in_toxic, in_others, len(toxic), len(unlabelled))]


def _telling(in_toxic: np.ndarray, in_others: np.ndarray, toxic: int, unlabelled: int) -> np.ndarray:
    pooled = (in_toxic + in_others) / (toxic + unlabelled)
    error = np.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / unlabelled)) + 1e-12
    off = np.abs(in_toxic / toxic - in_others / unlabelled) / error
    return (in_toxic + in_others >= LEAST_DOCUMENTS) & (off >= SIGNIFICANT)


def _numbers(vocabulary: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.isin(vocabulary, row, assume_unique=True))


@dataclass
class Placed:
    """Documents as the places of their words in a vocabulary that was told before."""

    vocabulary: np.ndarray
    rows: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.rows)


def train(toxic: list[np.ndarray] | Placed, unlabelled: list[np.ndarray] | Placed, prior: float) -> Model:
    """toxic and unlabelled: the distinct word hashes of each document, or both placed in one vocabulary."""
    if not isinstance(toxic, Placed):
        vocabulary = _telling_words(toxic, unlabelled)
        toxic, unlabelled = (Placed(vocabulary, [_numbers(vocabulary, row) for row in rows]) for rows in (toxic, unlabelled))
    return _descend(toxic.vocabulary, toxic.rows, unlabelled.rows, prior)


def _descend(vocabulary: np.ndarray, toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """toxic and unlabelled: the places of each document's words in the vocabulary."""
    size = len(vocabulary)
    positives, others = _Rows(toxic, size), _Rows(unlabelled, size)
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(11)
    batches = max(1, len(unlabelled) // 512)
    step = 0

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for epoch in range(EPOCHS):
        some_toxic = np.array_split(rng.permutation(len(toxic)), min(batches, len(toxic)))
        some_others = np.array_split(rng.permutation(len(unlabelled)), batches)
        for k in range(batches):
            p_score, p_flat, p_owner = positives.scores(some_toxic[k % len(some_toxic)], weights, bias)
            u_score, u_flat, u_owner = others.scores(some_others[k], weights, bias)
            p_share, u_share = prior / len(p_score), 1 / len(u_score)
            corrected = u_share * np.logaddexp(0, u_score).sum() - p_share * np.logaddexp(0, p_score).sum()
            if corrected >= 0:
                # slopes of loss(+) = log(1 + exp(-z)) and loss(-) = log(1 + exp(z)); their
                # difference on a toxic row is one
                p_slope, u_slope = np.full(len(p_score), -p_share), u_share * sigmoid(u_score)
            else:
                p_slope, u_slope = p_share * sigmoid(p_score), -u_share * sigmoid(u_score)
            slope = np.append(
                positives.slope(p_flat, p_owner, p_slope) + others.slope(u_flat, u_owner, u_slope) + DECAY * weights,
                p_slope.sum() + u_slope.sum(),
            )
            step += 1
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope**2
            change = RATE * (1 - epoch / EPOCHS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
            weights -= change[:-1]
            bias -= float(change[-1])
    return Model(vocabulary, weights, bias)


def fit(
    docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_unlabelled: int = FIT_UNLABELLED
) -> Model | None:
    """Learn from the learning fold; None if it has no toxic label.

    Of a repeated id the smallest text counts, so both limits are limits on rows.
    """
    marks = (
        labels.where(frames.learning_fold(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return None
    turn = (F.xxhash64("doc_id"), "doc_id")
    chosen = marks.where("toxic = 1").select("doc_id").orderBy(*turn).limit(fit_toxic)
    others = docs.select("doc_id").where(frames.learning_fold(F.col("doc_id")) & F.col("doc_id").isNotNull())
    others = frames.smallest_hashes(others, fit_unlabelled)
    wanted = (
        chosen.withColumn("toxic", F.lit(True))
        .unionByName(others.withColumn("toxic", F.lit(False)))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("only_toxic"))
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # bounded by the two limits
    sample = frames.one_text(sample, "toxic", "only_toxic")

    def convert(batch):
        for first, data, offsets in words.text_blocks(batch.column("text")):
            count = len(offsets) - 1
            hashes, rows = distinct_words(data, offsets)
            cuts = np.searchsorted(rows, np.arange(count + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(first, count) for c in ("doc_id", "toxic", "only_toxic")),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ],
                names=["doc_id", "toxic", "only_toxic", "words"],
            )

    # the words of all sampled documents stay with the executors; the driver gets the telling
    # ones and the places of each document's words among them
    held = frames.written(
        frames.map_batches(
            sample.selectExpr("cast(doc_id as long) doc_id", "text", "toxic", "only_toxic"),
            convert,
            "doc_id long, toxic boolean, only_toxic boolean, words binary",
        ),
        "sampled-words",
    )
    toxic_rows, unlabelled_rows = held.agg(F.count_if("toxic"), F.count_if(~F.col("only_toxic"))).first()
    if not toxic_rows or not unlabelled_rows:
        return None
    vocabulary = _sampled_vocabulary(held, toxic_rows, unlabelled_rows)

    def place(batch):
        rows = [_numbers(vocabulary, np.frombuffer(raw.as_buffer(), np.uint64)) for raw in batch.column("words")]
        places = pa.array([row.astype(np.int32).tobytes() for row in rows], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "toxic", "only_toxic")), places],
            names=["doc_id", "toxic", "only_toxic", "places"],
        )

    rows = frames.map_batches(held, place, "doc_id long, toxic boolean, only_toxic boolean, places binary").collect()
    rows = sorted((r.doc_id, r.toxic, r.only_toxic, bytes(r.places)) for r in rows)
    toxic = [np.frombuffer(raw, np.int32) for _, marked, _, raw in rows if marked]
    unlabelled = [np.frombuffer(raw, np.int32) for _, _, only, raw in rows if not only]
    return train(Placed(vocabulary, toxic), Placed(vocabulary, unlabelled), min(share, 0.99))


def _sampled_vocabulary(held: DataFrame, toxic: int, unlabelled: int) -> np.ndarray:
    """The telling words of the sampled documents, ascending; words are counted by Spark."""

    def count(batch):
        words_of = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column("words")]
        found, group = np.unique(np.concatenate(words_of), return_inverse=True)
        sizes = [len(row) for row in words_of]
        marked = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool), sizes)
        other = ~np.repeat(batch.column("only_toxic").to_numpy(zero_copy_only=False).astype(bool), sizes)
        counts = [np.bincount(group[chosen], minlength=len(found)).astype(np.int64) for chosen in (marked, other)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (found.view(np.int64), *counts))], names=["word", "in_toxic", "in_others"])

    def tell(batch):
        in_toxic, in_others = (batch.column(c).to_numpy() for c in ("in_toxic", "in_others"))
        yield batch.select(["word"]).filter(pa.array(_telling(in_toxic, in_others, toxic, unlabelled)))

    counts = frames.map_batches(held, count, "word long, in_toxic long, in_others long")
    counts = counts.groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_others").alias("in_others"))
    told = frames.map_batches(counts.where(F.col("in_toxic") + F.col("in_others") >= LEAST_DOCUMENTS), tell, "word long")
    return np.sort(np.array([r.word for r in told.collect()], np.int64).view(np.uint64))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = model or Model(np.empty(0, np.uint64), np.empty(0), -np.inf)

    def convert(batch):
        for first, data, offsets in words.text_blocks(batch.column("text")):
            scores = model.scores(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(scores)),
                    batch.column("held_out").slice(first, len(scores)),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    wanted = docs.select(F.col("doc_id").cast("long"), "text", frames.held_out(F.col("doc_id")).alias("held_out"))
    return frames.map_batches(wanted, convert, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose own text scores below the threshold."""
    if model is None:
        return docs
    schema = docs.schema

    def convert(batch):
        parts = [model.scores(data, offsets) < threshold for _, data, offsets in words.text_blocks(batch.column("text"))]
        yield batch.filter(pa.array(np.concatenate(parts)))

    return frames.map_batches(docs, convert, schema)
