"""Quality by labelling lines: a linear-chain conditional random field marks each line with a
word as content or boilerplate; the share of words in content lines decides retention.

Counts of words, symbols, repeated lines and repeated three-word windows are taken from the
whole text and reject the plainly bad documents first. The field is trained here: its line
labels come from documents labelled by quality (every line of a bad document counts as
boilerplate), on at most `fit_documents` of them, by gradient ascent on the log-likelihood
with forward-backward recursions. Decoding is exact (Viterbi).

Defined results: a null, empty or blank text has counts of zero and is not kept. Lines without
a word have no label. Repeated rows give repeated results. Without labels nothing is learnt,
and every line counts as content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import frames, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
FIT_DOCUMENTS = 3_000
LEAST_CONTENT = 0.5
ROUNDS = 120
FEATURES = 11

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!?;:=+-_~^@\\/[]{}()\"'"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


@dataclass
class Measured:
    """Counts of each row of a block, and its lines: row, word count and features of each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_rows: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    totals = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return totals[ends] - totals[starts]


def measure(data: np.ndarray, offsets: np.ndarray) -> Measured:
    count = len(offsets) - 1
    found = words.find_words(data, offsets)
    sums = words.prefix_sums(data)
    hashes = words.substring_hashes(sums, found.starts, found.ends)
    characters = (data & 0xC0) != 0x80
    n_words = found.counts()
    word_chars = np.zeros(count, np.int64)
    np.add.at(word_chars, found.rows, _sums(characters, found.starts, found.ends))

    repeated = np.zeros(len(hashes), bool)
    width = 3
    size = max(len(hashes) - width + 1, 0)
    inside = np.flatnonzero(found.rows[:size] == found.rows[width - 1 : width - 1 + size])
    windows = words.combine([hashes[inside + k] for k in range(width)] + [found.rows[inside].astype(np.uint64)])
    _, group, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = inside[times[group] > 1]
    for k in range(width):
        repeated[again + k] = True
    n_repeat_words = np.bincount(found.rows[repeated], minlength=count)

    # a line ends at each line feed and at the end of each row
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    rows = np.sort(np.concatenate([np.arange(count), np.searchsorted(offsets, feeds, "right") - 1]), kind="stable")
    first_word = np.searchsorted(found.starts, line_starts)
    line_words = np.searchsorted(found.starts, line_ends) - first_word
    spoken = line_words > 0
    line_starts, line_ends, rows = line_starts[spoken], line_ends[spoken], rows[spoken]
    first_word, line_words = first_word[spoken], line_words[spoken]
    keys = words.combine([words.substring_hashes(sums, line_starts, line_ends), rows.astype(np.uint64)])
    _, first_of, group = np.unique(keys, return_index=True, return_inverse=True)
    copied = first_of[group] != np.arange(len(keys))

    def share(flags):
        return _sums(flags, line_starts, line_ends) / np.maximum(line_ends - line_starts, 1)

    last = found.ends[first_word + line_words - 1] - 1 if len(rows) else np.empty(0, np.int64)
    features = np.column_stack(
        [
            np.ones(len(rows)),
            np.minimum(10 * share(_SYMBOL[data]), 3),
            share(_UPPER[data]) / np.maximum(share(_UPPER[data]) + share(_LOWER[data]), 0.05),
            share(_DIGIT[data]),
            np.minimum(10 * share(_MARKS[data]), 3),
            np.log1p(line_words) / 3,
            copied,
            _sums(repeated, first_word, first_word + line_words) / np.maximum(line_words, 1),
            _STOPS[data[last]] if len(rows) else np.empty(0),
            _sums(characters, line_starts, line_ends) / np.maximum(line_words, 1) / 10,
            line_words == 1,
        ]
    ).astype(np.float64)
    return Measured(
        n_words,
        word_chars,
        _sums(_SYMBOL[data], offsets[:-1], offsets[1:]),
        np.bincount(rows[copied], minlength=count),
        n_repeat_words,
        rows,
        line_words,
        features,
    )


@dataclass
class Field:
    """Weights of a two-state chain: state 0 is content, state 1 boilerplate."""

    emission: np.ndarray  # features x 2
    transition: np.ndarray  # from x to
    start: np.ndarray

    @staticmethod
    def empty() -> Field:
        return Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.array([1.0, 0.0]))

    def decode(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The likeliest states of all lines; rows, ascending, tells whose lines they are."""
        scores = features @ self.emission
        order, starts, sizes = _by_length(rows)
        states = np.zeros(len(rows), np.int64)
        if not len(order):
            return states
        choices = np.zeros((len(rows), 2), np.int8)
        best = self.start + scores[starts]
        for t in range(1, sizes[0]):
            live = np.searchsorted(-sizes, -t, "left")
            options = best[:live, :, None] + self.transition
            choice = options.argmax(1)
            at = starts[:live] + t
            choices[at] = choice
            best[:live] = np.take_along_axis(options, choice[:, None, :], 1)[:, 0] + scores[at]
        state = best.argmax(1)
        for t in range(sizes[0] - 1, -1, -1):
            live = np.searchsorted(-sizes, -t, "left")
            at = starts[:live] + t
            states[at] = state[:live]
            state[:live] = choices[at, state[:live]]
        return states


def _by_length(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have lines, longest first: place, first line and number of lines."""
    owners, starts, sizes = np.unique(rows, return_index=True, return_counts=True)
    order = np.argsort(-sizes, kind="stable")
    return owners[order], starts[order], sizes[order]


def train(features: np.ndarray, rows: np.ndarray, states: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Gradient ascent on the mean log-likelihood of the labelled chains."""
    field = Field(np.zeros((features.shape[1], 2)), np.zeros((2, 2)), np.zeros(2))
    order, starts, sizes = _by_length(rows)
    if not len(order):
        return Field.empty()
    chains = len(order)
    onehot = np.eye(2)[states]
    follows = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    seen_pairs = onehot[follows - 1].T @ onehot[follows]
    seen_start = onehot[starts].sum(0)
    parts = [field.emission, field.transition, field.start]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def log_sum(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        scores = features @ field.emission
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[starts] = field.start + scores[starts]
        for t in range(1, sizes[0]):
            at = starts[: np.searchsorted(-sizes, -t, "left")] + t
            forward[at] = scores[at] + log_sum(forward[at - 1][:, :, None] + field.transition, 1)
        for t in range(sizes[0] - 2, -1, -1):
            at = starts[: np.searchsorted(-sizes, -(t + 1), "left")] + t
            backward[at] = log_sum(field.transition + (scores[at + 1] + backward[at + 1])[:, None, :], 2)
        total = np.zeros(len(rows))
        ends = starts + sizes - 1
        total[ends] = log_sum(forward[ends], 1)
        total = np.repeat(total[ends], sizes)[np.argsort(_expand(starts, sizes), kind="stable")]
        single = np.exp(forward + backward - total[:, None])
        pairs = np.exp(
            forward[follows - 1][:, :, None]
            + field.transition
            + (scores[follows] + backward[follows])[:, None, :]
            - total[follows][:, None, None]
        ).sum(0)
        slopes = [features.T @ (onehot - single), seen_pairs - pairs, seen_start - single[starts].sum(0)]
        for k, (part, slope) in enumerate(zip(parts, slopes)):
            slope = slope / chains - 1e-3 * part
            means[k] = 0.9 * means[k] + 0.1 * slope
            squares[k] = 0.99 * squares[k] + 0.01 * slope**2
            part += 0.1 * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
    return field


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of each run."""
    before = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - before


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Field:
    """Train on at most `fit_documents` labelled documents, those with the smallest hashes of their ids.

    Of a repeated id the smallest text counts, so the bound is one on rows.
    """
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_documents)
    )
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by fit_documents
    labelled = frames.one_text(labelled, "quality")

    def convert(batch):
        quality = batch.column("quality").to_numpy()
        for first, data, offsets in words.text_blocks(batch.column("text")):
            found = measure(data, offsets)
            lines = [found.features[found.line_rows == i] for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(lines)),
                    pa.array(quality[first : first + len(lines)] == 0),
                    pa.array([x.astype(np.float32).tobytes() for x in lines], pa.binary()),
                ],
                names=["doc_id", "bad", "lines"],
            )

    rows = frames.map_batches(
        labelled.selectExpr("cast(doc_id as long) doc_id", "text", "cast(quality as int) quality"),
        convert,
        "doc_id long, bad boolean, lines binary",
    ).collect()
    rows = sorted(((r.doc_id, r.bad, bytes(r.lines)) for r in rows if r.lines), key=lambda r: (r[0], r[2]))
    if len({bad for _, bad, _ in rows}) < 2:
        return Field.empty()
    features = [np.frombuffer(raw, np.float32).reshape(-1, FEATURES).astype(np.float64) for _, _, raw in rows]
    sizes = [len(x) for x in features]
    owners = np.repeat(np.arange(len(rows)), sizes)
    states = np.repeat(np.array([bad for _, bad, _ in rows], np.int64), sizes)
    return train(np.concatenate(features), owners, states)


def assess(docs: DataFrame, field: Field, least_content: float = LEAST_CONTENT) -> DataFrame:
    """The counts, base_failed, content_share, n_lines, n_content_lines and kept of every document."""

    def convert(batch):
        for first, data, offsets in words.text_blocks(batch.column("text")):
            m = measure(data, offsets)
            content = field.decode(m.features, m.line_rows) == 0
            count = len(m.n_words)
            spoken = np.bincount(m.line_rows[content], m.line_words[content], count)
            share = spoken / np.maximum(m.n_words, 1)
            failed = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > MOST_REPEATED_PERCENT * m.n_words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, count),
                    *(
                        pa.array(x.astype(np.int64))
                        for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
                    ),
                    pa.array(failed),
                    pa.array(~failed & (share >= least_content)),
                    pa.array(share),
                    pa.array(np.bincount(m.line_rows, minlength=count).astype(np.int64)),
                    pa.array(np.bincount(m.line_rows[content], minlength=count).astype(np.int64)),
                ],
                names=_NAMES,
            )

    return frames.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), convert, _SCHEMA)


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
)
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]
