import itertools
import random
import re
from collections import Counter

import numpy as np

from sensorloom.llm import quality_lines

from .conftest import by_id, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    found = re.findall(WORD, text or "")
    windows = list(zip(found, found[1:], found[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            copies += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(covered)


def some_texts():
    rng = random.Random(4)
    made = []
    for seed in range(60):
        lines = [" ".join(words(rng.randint(0, 12), rng.randint(0, 9), 30)) for _ in range(rng.randint(0, 12))]
        lines += rng.choices(lines, k=len(lines) // 3)
        made.append(rng.choice(["\n", "\r\n", "\n\n"]).join(lines) + rng.choice(["", "#", " | |", "\n"]))
    return made


def test_counts_equal_brute_force(corpus):
    texts = some_texts() + [None, "", " ", "\n", "a\x0bb\x0ca", "é é é é"]
    frame = quality_lines.assess(corpus.documents(texts), quality_lines.Field.empty())
    assert by_id(frame, *COUNTS) == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)


def test_base_rule(corpus):
    texts = [" ".join(words(60, 1, 5000)), " ".join(words(49, 2, 5000)), "a b c " * 40]
    frame = quality_lines.assess(corpus.documents(texts), quality_lines.Field.empty())
    assert by_id(frame, "base_failed", "kept") == [(0, False, True), (1, True, False), (2, True, False)]


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(3)
    field = quality_lines.Field(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    rows = np.repeat([0, 2, 3, 7], [1, 6, 3, 8])
    features = rng.normal(size=(len(rows), 4))
    states = field.decode(features, rows)
    for owner in set(rows):
        scores = features[rows == owner] @ field.emission

        def value(path):
            steps = sum(field.transition[a, b] for a, b in zip(path, path[1:]))
            return field.start[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + steps

        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert tuple(states[rows == owner]) == best


def test_training_separates_lines(corpus, spark):
    rng = random.Random(8)
    good = ["\n".join(" ".join(words(20, s * 9 + k)) + "." for k in range(6)) for s in range(60)]
    bad = ["\n".join(" | ".join(words(20, 7000 + s * 9 + k)) + " ###" for k in range(6)) for s in range(60)]
    texts = good + bad
    order = list(range(120))
    rng.shuffle(order)
    docs = corpus.documents([(i, texts[i]) for i in order])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    field = quality_lines.fit(docs, labels)
    kept = {r.doc_id: r.kept for r in quality_lines.assess(docs, field).collect()}
    assert all(kept[i] == (i < 60) for i in range(1, 120, 2))


def test_odd_rows_and_no_labels(corpus, spark):
    labels = spark.createDataFrame([(None, 1), (6, None), (1, 0)], "doc_id long, quality int")
    field = quality_lines.fit(corpus.odd(), labels)
    frame = quality_lines.assess(corpus.odd(), field)
    assert by_id(frame, *COUNTS) == sorted(((r.doc_id, *brute(r.text)) for r in corpus.odd().collect()), key=str)
    assert quality_lines.assess(corpus.none(), quality_lines.fit(corpus.none(), labels)).count() == 0
