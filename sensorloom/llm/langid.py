"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its runs of 3 and 4 bytes (ASCII lower-cased, white space as one mark),
hashed into buckets. The embeddings of all its subwords are averaged over the whole text and
go through a linear softmax. Embeddings and softmax are trained together by stochastic
gradient descent in numpy, on about `fit_per_language` documents of each language; a fifth
of them is kept out of training and calibrates a temperature and the confidence under which a
prediction is rejected.

The average is linear, so prediction looks up embedding times softmax, one small row a subword.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every
text when no language could be learnt. A text with letters always has a learnt language in the
query; `accepted` tells whether calibration trusts it. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words

BUCKETS = 1 << 15
DIMENSIONS = 16
ORDERS = (3, 4)
FIT_PER_LANGUAGE = 800
FIT_LANGUAGES = 1_000
EPOCHS = 4
RATE = 2.0
TRUSTED = 0.99
UNKNOWN = "und"
_CHANCES = 1 << 53

_LETTER = regex.compile(r"\p{L}")
_FOLD = words.lower_ascii(np.arange(256, dtype=np.uint8))
_FOLD[list(words.SEPARATORS)] = 32


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each order: bucket and row of every subword that lies within a row."""
    folded = _FOLD[data].astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for order in ORDERS:
        count = max(len(data) - order + 1, 0)
        value = np.full(count, order, np.uint32)
        for k in range(order):
            value = value * np.uint32(0x01000193) + folded[k : k + count]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA6B)
        value >>= np.uint32(32 - BUCKETS.bit_length() + 1)
        inside = rows[:count] == rows[order - 1 : order - 1 + count]
        yield value[inside], rows[:count][inside]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        count = len(offsets) - 1
        sums, totals = np.zeros((count, len(self.languages))), np.zeros(count)
        for buckets, rows in subwords(data, offsets):
            if not len(rows):
                continue
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sums[rows[heads]] += np.add.reduceat(self.table[buckets], heads, axis=0)
            totals[rows[heads]] += np.diff(np.append(heads, len(rows)))
        return sums / np.maximum(totals, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    power = np.exp(logits - logits.max(-1, keepdims=True))
    return power / power.sum(-1, keepdims=True)


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """samples: language, buckets and their counts of each document, in a fixed order."""
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    kept_out = np.arange(len(samples)) % 5 == 4
    learning = np.flatnonzero(~kept_out)
    steps = EPOCHS * len(learning)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learning):
            language, buckets, counts = samples[i]
            weights = counts / counts.sum()
            hidden = weights @ embedding[buckets]
            error = _softmax(hidden @ softmax + bias)
            error[language] -= 1
            rate = RATE * (1 - step / steps)
            step += 1
            slope = softmax @ error
            softmax -= 0.1 * rate * np.outer(hidden, error)
            bias -= 0.01 * rate * error
            # a bucket's step follows its share of the text, scaled by how many buckets share it
            embedding[buckets] -= rate * np.sqrt(len(buckets)) * np.outer(weights, slope)
    model = Model(languages, embedding @ softmax, bias)
    if kept_out.any():
        logits = np.array([s[2] / s[2].sum() @ model.table[s[1]] + bias for s, k in zip(samples, kept_out) if k])
        truth = np.array([s[0] for s, k in zip(samples, kept_out) if k])
        _calibrate(model, logits, truth)
    return model


def _calibrate(model: Model, logits: np.ndarray, truth: np.ndarray) -> None:
    """The temperature of least log-loss, then the least score whose accepted share is trusted."""
    at = np.arange(len(truth))
    losses = {t: -np.log(_softmax(logits / t)[at, truth] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
    model.temperature = float(min(losses, key=losses.get))
    scores = model.scores(logits)
    order = np.argsort(-scores.max(1), kind="stable")
    right = np.cumsum(scores.argmax(1)[order] == truth[order]) / (at + 1)
    trusted = np.flatnonzero(right >= TRUSTED)
    model.least_score = float(scores.max(1)[order][trusted[-1]]) if len(trusted) else 1.0


def fit(docs: DataFrame, fit_per_language: int = FIT_PER_LANGUAGE, fit_languages: int = FIT_LANGUAGES) -> Model | None:
    """Learn from the labelled documents of the learning fold; None if there are none.

    Takes, by the hashes of their ids, about `fit_per_language` documents of each of the
    `fit_languages` most frequent languages, or all where there are fewer. Of an id that is
    repeated in a language the smallest text counts. Languages beyond `fit_languages` are not
    learnt: the limit bounds the model, which has one column for each.
    """
    labelled = docs.select("doc_id", "lang").where(
        frames.learning_fold(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    ids = F.approx_count_distinct("doc_id", 0.02).alias("count")
    frequent = labelled.groupBy("lang").agg(ids).orderBy(F.desc("count"), "lang").limit(fit_languages)
    # a hash below each language's share of its documents takes about fit_per_language of them
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(_CHANCES)).cast("double") * F.col("count") < F.lit(float(fit_per_language * _CHANCES))
    shares = F.broadcast(frequent.withColumnRenamed("lang", "_lang"))  # bounded by fit_languages
    usable = frames.learning_fold(F.col("doc_id")) & (F.length("text") > 0)
    sample = docs.select("doc_id", "text", "lang").where(usable).join(shares, F.col("lang") == F.col("_lang")).where(chance)
    sample = frames.one_text(sample, "lang")

    def convert(batch):
        for first, data, offsets in words.text_blocks(batch.column("text")):
            count = len(offsets) - 1
            found = list(subwords(data, offsets))
            buckets, counts = [], []
            for row in range(count):
                own = np.concatenate([b[slice(*np.searchsorted(r, [row, row + 1]))] for b, r in found])
                tally = np.bincount(own, minlength=BUCKETS)
                seen = np.flatnonzero(tally)
                buckets.append(seen.astype("<u2").tobytes())
                counts.append(tally[seen].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, count),
                    batch.column("lang").slice(first, count),
                    pa.array(buckets, pa.binary()),
                    pa.array(counts, pa.binary()),
                ],
                names=["doc_id", "lang", "buckets", "counts"],
            )

    rows = frames.map_batches(
        sample.selectExpr("cast(doc_id as long) doc_id", "text", "lang"),
        convert,
        "doc_id long, lang string, buckets binary, counts binary",
    ).collect()
    rows = sorted(((r.doc_id, r.lang, bytes(r.buckets), bytes(r.counts)) for r in rows if r.buckets))
    if not rows:
        return None
    languages = sorted({lang for _, lang, _, _ in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    samples = [
        (place[lang], np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.float64))
        for _, lang, b, c in rows
    ]
    return train(samples, languages)


def predict(docs: DataFrame, model: Model | None, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted; with reject, what is not accepted is `und`."""
    model = model or Model([], np.zeros((BUCKETS, 0)), np.zeros(0))

    def convert(batch):
        texts = batch.column("text")
        for first, data, offsets in words.text_blocks(texts):
            count = len(offsets) - 1
            spoken = np.array([bool(t and _LETTER.search(t)) for t in texts.slice(first, count).to_pylist()])
            if model.languages:
                scores = model.scores(model.logits(data, offsets))
                names = [model.languages[i] for i in scores.argmax(1)]
                best = scores.max(1)
            else:
                spoken, names, best = np.zeros(count, bool), [UNKNOWN] * count, np.zeros(count)
            accepted = spoken & (best >= model.least_score)
            shown = accepted if reject else spoken
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, count),
                    batch.column("held_out").slice(first, count),
                    pa.array([name if ok else UNKNOWN for name, ok in zip(names, shown)], pa.string()),
                    pa.array(np.where(spoken, np.clip(best, 0, 1), 0.0)),
                    pa.array(accepted),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    wanted = docs.select(F.col("doc_id").cast("long"), "text", frames.held_out(F.col("doc_id")).alias("held_out"))
    return frames.map_batches(
        wanted, convert, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    )
