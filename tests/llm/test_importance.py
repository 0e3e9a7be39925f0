import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sensorloom.llm import importance

from .conftest import by_id, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = "item_id long, text string"


def features(text, longest):
    found = WORD.findall((text or "").translate(UPPER))
    return len(found), [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def brute(rows, target, buckets=10_000, longest=1, least_words=20, percent=10, seed=2024):
    def placed(text):
        size, found = features(text, longest)
        return size, [zlib.crc32(x.encode()) % buckets for x in found]

    own = [placed(t) for _, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, own), (t, [placed(x) for x in target])):
        for _, found in texts:
            for bucket in found:
                counts[bucket] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    result = []
    for (doc_id, _), (size, found) in zip(rows, own):
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        result.append([doc_id, len(found), weight, score, None, size])
    fit = [r for r in result if r[5] >= least_words]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(row[:5]) for row in result), key=str)


def texts_of(seed, count=90):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        joined = "".join(w + rng.choice([" ", "  ", "\n", "-", ", ", "\x00", "É "]) for w in words(rng.randint(0, 60), seed + i))
        rows.append((i * 11 % 997, joined.title() if i % 3 else joined))
    return rows


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 500, 35), (3, 10_000, 100)])
def test_equals_brute_force(corpus, spark, longest, buckets, percent):
    rows, target = texts_of(4), [" ".join(words(30, 70 + i)) for i in range(6)]
    benchmark = spark.createDataFrame(list(enumerate(target)), TARGET)
    found = importance.resample(corpus.documents(rows), benchmark, buckets=buckets, longest=longest, percent=percent)
    stated = brute(rows, target, buckets, longest, percent=percent)
    assert by_id(found, "n_features", "weight", "score", "rank") == stated
    drawn = [row for row in stated if row[4]]
    assert drawn and sorted(row[4] for row in drawn) == list(range(1, len(drawn) + 1))
    kept = importance.sample(corpus.documents(rows), benchmark, buckets=buckets, longest=longest, percent=percent)
    assert by_id(kept, "rank") == sorted(((row[0], row[4]) for row in drawn), key=str)


def test_spans_of_runs_and_their_sums():
    rng = random.Random(1)
    texts = [t for _, t in texts_of(9)] + ["", " ", "a", "x" * 300 + " " + "y" * 64 + " " + "z" * 63, "\n\n b  \n c"]
    for longest in (1, 2, 4):
        bucket, ends, counts = importance.bucketed([t.encode() for t in texts], 1 << 20, longest)
        for i, text in enumerate(texts):
            size, found = features(text, longest)
            assert counts[i] == size
            stated = sorted(zlib.crc32(x.encode()) % (1 << 20) for x in found)
            assert sorted(bucket[ends[i] : ends[i + 1]].tolist()) == stated
    data = bytes(rng.randrange(256) for _ in range(900))
    starts = np.array([rng.randrange(900) for _ in range(200)] + [5, 0])
    ends = np.minimum(starts + np.array([rng.choice([0, 1, 7, 63, 64, 65, 400]) for _ in range(202)]), 900)
    assert importance.crc32_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]


def test_overlapped_scanning_equals_word_windows():
    data = b" the cat sat \n on the \n  \n mat "
    assert [m.group() for m in importance.run_pattern(2).finditer(data, overlapped=True)] == [b"the cat", b"cat sat", b"on the"]
    assert [m.group() for m in importance.run_pattern(1).finditer(data, overlapped=True)] == data.split()


def test_ties_go_to_the_smaller_id(corpus, spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(importance, "noise", lambda seed: F.lit(7).cast("long"))
    rows = [((i * 37) % 400, " ".join(["same"] * 25)) for i in range(400)]
    benchmark = spark.createDataFrame([(1, "same")], TARGET)
    found = importance.sample(corpus.documents(rows), benchmark, percent=20)
    assert by_id(found, "rank") == sorted(((i, i + 1) for i in range(80)), key=str)


def test_odd_rows(corpus, spark):
    rows = [(r.doc_id, r.text) for r in corpus.odd().collect()]
    benchmark = spark.createDataFrame([(None, None), (1, ""), (2, "same words é")], TARGET)
    found = importance.resample(corpus.odd(), benchmark, least_words=1, percent=50)
    assert by_id(found, "n_features", "weight", "score", "rank") == brute(rows, [None, "", "same words é"], least_words=1, percent=50)
    nothing = spark.createDataFrame([], TARGET)
    assert importance.resample(corpus.none(), benchmark).count() == 0
    assert by_id(importance.resample(corpus.odd(), nothing), "weight") == sorted(
        [(row[0], row[2]) for row in brute(rows, [])], key=str
    )
