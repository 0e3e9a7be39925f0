import random

import pytest


class Corpus:
    """Small tables of documents, with the rows no operator may stumble over."""

    SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

    def __init__(self, spark):
        self.spark = spark

    def documents(self, texts, lang=None):
        """Texts by ascending doc_id, or (doc_id, text) pairs."""
        rows = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(texts)]
        full = [(i, t, lang, "here", None if t is None else len(t)) for i, t in rows]
        return self.spark.createDataFrame(full, self.SCHEMA)

    def odd(self):
        """Nulls in any column, empty and very long texts, repeated rows, extra and clashing columns."""
        long = " ".join(words(40_000, seed=1))
        rows = [
            (1, None, None, None, None),
            (2, "", "en", "a", 0),
            (3, " \n\t ", "en", "a", 4),
            (None, "a row without an id", "en", None, 19),
            (4, "é", None, "a", 1),
            (5, long, "en", "a", len(long)),
            (6, "same words in the same row", "en", "a", 26),
            (6, "same words in the same row", "en", "a", 26),
            (7, "one id with a text", "en", "a", 18),
            (7, "one id with another", "en", "a", 19),
            (8, "nul \x00 and   and \U0001f600", "en", "a", 17),
        ]
        extra = [(*row, i, "x", -1.0, "y", None, 0) for i, row in enumerate(rows)]
        names = ", node long, row_key string, score double, lead string, keys long, runs int"
        return self.spark.createDataFrame(extra, self.SCHEMA + names)

    def none(self):
        return self.spark.createDataFrame([], self.SCHEMA)


def words(count, seed=0, vocabulary=400):
    rng = random.Random(seed)
    made = ["".join(rng.choices("abcdefghiklmnoprstuvé", k=rng.randint(2, 9))) for _ in range(vocabulary)]
    return rng.choices(made, k=count)


@pytest.fixture(scope="session")
def corpus(spark):
    return Corpus(spark)


def by_id(frame, *columns):
    return sorted((tuple(row[c] for c in ("doc_id", *columns)) for row in frame.collect()), key=str)
